"""Sources, sinks and indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import sql as S
from tessera.functions.series import by_day, ahead, is_true, past, roll, rounded, symbol_pair, with_least
from tessera.operators import indicators as I  # noqa: E741
from tessera.sources import panels, state
from tessera.sources.tables import StateTable

OHLCV = ("open", "high", "low", "close", "volume")


def one(name):
    def run(spark, d):
        return I.with_indicators(panels.bars_1d(spark, d), [name]).select("symbol", "d", F.round(name, 6).alias("value"))

    return run


def ind_table(spark, d):
    return I.with_indicators(panels.bars_1d(spark, d))


def complete(spark, d):
    """All indicators of the registry; the three series stand for a price index, a rate and claims."""
    from tessera.operators import vintage as V

    return I.complete(panels.bars_1d(spark, d), panels.funding(spark, d), panels.calendar(spark, d), V.surprises(panels.macro_vintage(spark, d)), SERIES)


SERIES = {"cpi_surprise": "1-URGENT", "rate_surprise": "2-HIGH", "jobless_claims_surprise": "3-MEDIUM"}
LEADUP = ["close_return_1d", "shock_zscore", "rsi_14d", "volume_zscore_30d", "funding_zscore_30d", "bollinger_pctb_20d"]


def synthetic(spark, d):
    """The synthetic indicators over the change of the three days ahead."""
    df = panels.bars_1d(spark, d).withColumn("f", F.lead("close", 3).over(by_day()) / F.col("close") - 1)
    df = I.with_planted_apart(df, "apart", "f", "A", 0.3, 0.1)
    return df.select("symbol", "d", I.planted("f", 0.2).alias("planted"), I.at_random(0.05).alias("random"), I.on_days(list(panels.LITERAL_DAYS)).alias("news"), "apart", F.round(I.sentiment("f", 0.4), 6).alias("sentiment"))


def tight(spark, d):
    width = with_least(4 * F.stddev_samp("close").over(roll(20)) / F.avg("close").over(roll(20)), F.col("close"), roll(20), 20)
    df = I.with_inputs(panels.bars_1d(spark, d)).withColumn("tight", is_true(width < 0.75))
    return df.select("symbol", "d", (F.min(F.col("tight").cast("int")).over(roll(5)) == 1).alias("tight_5"))


def scaled_move(spark, d):
    df = I.with_inputs(panels.bars_1d(spark, d)).withColumn("f", F.lead("close", 3).over(by_day()) / F.col("close") - 1)
    f = F.col("f")
    df = df.withColumn("sd", with_least(F.stddev_samp(f).over(past(180)), f, past(180), 60)).withColumn("scaled", F.abs(F.try_divide(f, F.col("sd")))).withColumn("eff", I.forward_efficiency(3))
    return df.select("symbol", "d", *rounded("scaled", "eff"), (is_true(F.col("scaled") >= 1) & is_true(F.col("eff") >= 0.5)).alias("trend"))


def bucketed_upsert(s, d):
    """Customers' greatest orders in place of their balances, in a table by bucket and in two batches; a repeated batch changes nothing."""
    new = panels.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    table = StateTable(s, f"{state.shared_folder(s)}/customers-{uuid.uuid4().hex}", "c_custkey long, c_acctbal double", ["c_custkey"], 32)
    for epoch, batch in enumerate((panels.table(s, d, "customer").select("c_custkey", "c_acctbal"), new, new)):
        table.apply(batch, epoch=min(epoch, 1))
    return table.read()


SERIES_TABLE = "SELECT symbol, d, round({0}, 6) AS value FROM ind"
QUERIES = {
    "src_daily_scan": lambda s, d: panels.bars_1d(s, d).select("symbol", "d", *OHLCV),
    "src_region_bars": lambda s, d: panels.bars_by_region(s, d).select("symbol", "d", *OHLCV),
    "src_hourly_scan": lambda s, d: panels.bars_1h(s, d).select("symbol", "ts", *OHLCV),
    "src_funding_daily_mean": lambda s, d: panels.funding(s, d).select("symbol", "d", F.round("rate", 6).alias("rate")),
    "src_vintage_scan": lambda s, d: panels.macro_vintage(s, d),
    "src_release_dates": lambda s, d: panels.macro_vintage(s, d).where("realtime_start > DATE '1996-01-01'").select("series", "realtime_start").distinct(),
    "src_literal_days": lambda s, d: panels.literal_days(s),
    "src_open_trades": lambda s, d: panels.table(s, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey", "o_totalprice"),
    "src_last_closed_trade": lambda s, d: panels.table(s, d, "orders").where("o_orderstatus = 'F'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(1).select("o_orderkey", "o_totalprice"),
    "src_news_projection": lambda s, d: panels.table(s, d, "events").select("event_id", F.upper("event_type").alias("headline"), F.substring("props", 1, 500).alias("summary"), F.coalesce(F.get_json_object("props", "$.source"), F.lit("unknown")).alias("source"), F.get_json_object("props", "$.k").cast("bigint").alias("k")),
    "snk_dedup_keep_last": lambda s, d: state.keep_last(panels.table(s, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice"),
    "snk_upsert": lambda s, d: state.upsert(panels.table(s, d, "customer").select("c_custkey", "c_acctbal"), panels.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")), ["c_custkey"]),
    "snk_bucketed_upsert": bucketed_upsert,
    "snk_insert_missing": lambda s, d: state.insert_missing(panels.table(s, d, "orders").select("o_custkey").distinct(), panels.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]),
    "snk_append_ordinal": lambda s, d: state.append_numbered(panels.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), panels.table(s, d, "region").select(F.col("r_name").alias("name")).withColumn("id", F.lit(None).cast("long")), F.col("name")).select("id", "name"),
    "snk_symbol_map": lambda s, d: panels.table(s, d, "nation").select("n_name", symbol_pair(F.concat("n_name", F.lit("USDT"))).alias("pair")),
    "ind_funding_z_ffill": lambda s, d: I.with_funding(panels.bars_1d(s, d), panels.funding(s, d)).select("symbol", "d", *rounded("rate", "funding_zscore_30d")),
    "ind_macro_day": lambda s, d: I.with_macro_day(panels.bars_1d(s, d), panels.calendar(s, d)).select("symbol", "d", F.col("is_macro_day").cast("int").alias("is_macro_day")),
    "ind_surprise": lambda s, d: complete(s, d).select("symbol", "d", *rounded(*SERIES)),
    "ind_complete": lambda s, d: complete(s, d).select("symbol", "d", *rounded("rsi_14d", "atr_pct_14d", "funding_zscore_30d"), "is_macro_day"),
    "ind_readings": lambda s, d: I.snapshot(complete(s, d), list(I.INDICATORS), non_null=True).select("symbol", "indicator", F.round("value", 6).alias("value")),
    "ind_synthetic": synthetic,
    "ind_wilder_rsi_atr": lambda s, d: I.wilder(panels.bars_1d(s, d)).select("symbol", "d", F.round(F.nanvl("rsi", F.lit(None).cast("double")), 6).alias("rsi"), F.round(F.nanvl("atr_pct", F.lit(None).cast("double")), 6).alias("atr_pct")),
    "ind_macd_cross": lambda s, d: I.macd_cross(panels.bars_1d(s, d)),
    "ind_stochastic_exit": lambda s, d: ind_table(s, d).select("symbol", "d", is_true((F.col("stochastic_k_14d") > 20) & (F.lag("stochastic_k_14d").over(by_day()) <= 20)).alias("exits_low")),
    "ind_range_p95": lambda s, d: I.with_inputs(panels.bars_1d(s, d)).select("symbol", "d", is_true(I.range_above_p95()).alias("wide")),
    "ind_rank_pct": lambda s, d: I.with_inputs(panels.bars_1d(s, d)).select("symbol", "d", F.round(I.rank_pct("range_pct"), 6).alias("rank_pct")),
    "ind_bb_tight5": tight,
    "ind_move5_transition": lambda s, d: ind_table(s, d).select("symbol", "d", I.transitions(F.col("close_return_5d") <= -0.1).alias("falls"), I.transitions(F.col("close_return_5d") >= 0.1).alias("rises")),
    "ind_fwd_efficiency": lambda s, d: I.with_inputs(panels.bars_1d(s, d)).select("symbol", "d", F.round(I.forward_efficiency(7), 6).alias("eff")),
    "ind_scaled_move_trend": scaled_move,
    "ind_snapshot_unpivot": lambda s, d: I.snapshot(complete(s, d), list(I.INDICATORS)).select("symbol", "indicator", F.round("value", 6).alias("value")),
    "ind_leadup_tail": lambda s, d: I.leadup(complete(s, d), LEADUP).select("symbol", "d", *rounded(*LEADUP)),
    "ind_price_snapshot": lambda s, d: I.price_snapshot(panels.bars_1d(s, d), F.lit("1998-06-30").cast("date")).select("symbol", "d", "close", *rounded("change_1", "change_7")),
}
QUERIES |= {f"ind_{n}": one(n) for n in I.from_bars()}

UPSERTED = "WITH n AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY 1) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, c_acctbal FROM n"
ORACLE = {
    "ind_surprise": S.recursive(f"SELECT symbol, d, {S.r('cpi_surprise', 'rate_surprise', 'jobless_claims_surprise')} FROM whole", *S.ALL),
    "ind_complete": S.recursive(f"SELECT symbol, d, {S.r('rsi_14d', 'atr_pct_14d', 'funding_zscore_30d')}, is_macro_day FROM whole", *S.ALL),
    "ind_wilder_rsi_atr": S.recursive("SELECT symbol, d, round(rsi_14d, 6) AS rsi, round(atr_pct_14d, 6) AS atr_pct FROM wilder", S.BARS, S.WILDER),
    "ind_macd_cross": S.recursive(f"SELECT symbol, d, side <> coalesce(lag(side) OVER ({S.W}), 0) AS crossed FROM macd", S.BARS, S.MACD),
    "ind_snapshot_unpivot": S.recursive("SELECT symbol, indicator, round(value, 6) AS value FROM (SELECT symbol, " + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in I.INDICATORS) + " FROM whole QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1) UNPIVOT INCLUDE NULLS (value FOR indicator IN (" + ", ".join(I.INDICATORS) + "))", *S.ALL),
    "ind_readings": S.recursive("SELECT symbol, indicator, round(value, 6) AS value FROM (SELECT symbol, " + ", ".join(f"CAST(arg_max({n}, d) FILTER ({n} IS NOT NULL) AS DOUBLE) AS {n}" for n in I.INDICATORS) + " FROM whole GROUP BY 1) UNPIVOT INCLUDE NULLS (value FOR indicator IN (" + ", ".join(I.INDICATORS) + "))", *S.ALL),
    "ind_leadup_tail": S.recursive(f"SELECT symbol, d, {S.r(*LEADUP)} FROM whole QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 7", *S.ALL),
    "ind_price_snapshot": S.sql(f"SELECT symbol, d, close, round(CASE WHEN n >= 8 THEN c1 END, 6) AS change_1, round(CASE WHEN n >= 8 THEN c7 END, 6) AS change_7 FROM (SELECT *, row_number() OVER ({S.W}) AS n, close / lag(close) OVER ({S.W}) - 1 AS c1, close / lag(close, 7) OVER ({S.W}) - 1 AS c7 FROM bars WHERE d <= DATE '1998-06-30') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1", S.BARS),
    "ind_move5_transition": S.sql(f"SELECT symbol, d, low AND NOT coalesce(lag(low) OVER ({S.W}), false) AS falls, high AND NOT coalesce(lag(high) OVER ({S.W}), false) AS rises FROM (SELECT symbol, d, coalesce(close_return_5d <= -0.1, false) AS low, coalesce(close_return_5d >= 0.1, false) AS high FROM ind)", S.BARS, S.IND),
    "ind_synthetic": S.sql(f"SELECT symbol, d, CAST(coalesce(f >= quantile_cont(f, 0.8) OVER (PARTITION BY symbol) AND {S.uniform('planted', 'symbol', 'd')} < 0.02 / 0.2, false) AS DOUBLE) AS planted, CAST({S.uniform('random', 'symbol', 'd')} < 0.05 AS DOUBLE) AS random, CAST(d IN (DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16') AS DOUBLE) AS news, CAST(coalesce(symbol = 'A' AND apart >= quantile_cont(CASE WHEN symbol = 'A' THEN apart END, 0.7) OVER () AND {S.uniform('apart', 'symbol', 'd')} < 0.1 / 0.3, false) AS DOUBLE) AS apart, round(0.4::DOUBLE * (f - avg(f) OVER (PARTITION BY symbol)) / stddev_samp(f) OVER (PARTITION BY symbol) + sqrt(1 - 0.4::DOUBLE * 0.4::DOUBLE) * sqrt(-2 * ln({S.uniform('sentiment1', 'symbol', 'd')} + pow(2.0::DOUBLE, -53))) * cos({S.uniform('sentiment2', 'symbol', 'd')} * 2 * pi()), 6) AS sentiment FROM (SELECT *, f - avg(f) OVER (PARTITION BY d) AS apart FROM (SELECT *, lead(close, 3) OVER ({S.W}) / close - 1 AS f FROM bars))", S.BARS),
    "src_daily_scan": S.sql("SELECT symbol, d, open, high, low, close, volume FROM bars", S.BARS),
    "src_region_bars": S.sql("SELECT symbol, d, open, high, low, close, volume FROM bars", S.REGION_BARS),
    "src_hourly_scan": S.sql("SELECT symbol, ts, open, high, low, close, volume FROM hours", S.HOURS),
    "src_funding_daily_mean": S.sql("SELECT symbol, d, round(rate, 6) AS rate FROM funding", S.FUNDING),
    "src_vintage_scan": S.sql("SELECT series, period, realtime_start, value FROM vintage", S.VINTAGE),
    "src_release_dates": S.sql("SELECT DISTINCT series, realtime_start FROM vintage WHERE realtime_start > DATE '1996-01-01'", S.VINTAGE),
    "src_literal_days": "SELECT unnest([DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16']) AS d",
    "src_open_trades": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'",
    "src_last_closed_trade": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "src_news_projection": "SELECT event_id, upper(event_type) AS headline, substr(props, 1, 500) AS summary, coalesce(json_extract_string(props, '$.source'), 'unknown') AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "snk_dedup_keep_last": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "snk_upsert": UPSERTED,
    "snk_bucketed_upsert": UPSERTED,
    "snk_insert_missing": "SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer",
    "snk_append_ordinal": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name), r_name FROM region",
    "snk_symbol_map": "SELECT n_name, n_name || '/USDT' AS pair FROM nation",
    "ind_funding_z_ffill": S.sql(f"SELECT symbol, d, round(rate, 6) AS rate, round({S.z('rate', 30, 15)}, 6) AS funding_zscore_30d FROM (SELECT b.symbol, b.d, last_value(rate IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM bars b LEFT JOIN funding f ON b.symbol = f.symbol AND b.d = f.d)", S.BARS, S.FUNDING),
    "ind_macro_day": S.sql("SELECT symbol, d, CAST(d IN (SELECT d FROM calendar) AS INTEGER) AS is_macro_day FROM bars", S.BARS, S.CALENDAR),
    "ind_stochastic_exit": S.sql(f"SELECT symbol, d, coalesce(stochastic_k_14d > 20 AND lag(stochastic_k_14d) OVER ({S.W}) <= 20, false) AS exits_low FROM ind", S.BARS, S.IND),
    "ind_range_p95": S.sql(f"SELECT symbol, d, coalesce(CASE WHEN {S.past('count(range_pct)', 180)} >= 60 THEN range_pct > {S.past('quantile_cont(range_pct, 0.95)', 180)} END, false) AS wide FROM base", S.BARS, S.IND),
    "ind_rank_pct": S.sql(f"SELECT symbol, d, round(CASE WHEN len(f) >= 60 THEN (len(list_filter(f, lambda v: v < range_pct)) + (len(list_filter(f, lambda v: v = range_pct)) + 1) / 2.0) / len(f) END, 6) AS rank_pct FROM (SELECT symbol, d, range_pct, {S.roll('list(range_pct)', 180)} AS f FROM base)", S.BARS, S.IND),
    "ind_bb_tight5": S.sql(f"SELECT symbol, d, {S.roll('min(tight)', 5)} = 1 AS tight_5 FROM (SELECT symbol, d, CAST(coalesce({S.full('4 * ' + S.roll('stddev_samp(close)', 20) + ' / ' + S.roll('avg(close)', 20), 'close', 20)} < 0.75, false) AS INTEGER) AS tight FROM bars)", S.BARS),
    "ind_fwd_efficiency": S.sql(f"SELECT symbol, d, round(abs(lead(close, 7) OVER ({S.W}) - close) / nullif({S.ahead('sum(chg)', 1, 7)}, 0), 6) AS eff FROM base", S.BARS, S.IND),
    "ind_scaled_move_trend": S.sql("SELECT symbol, d, round(scaled, 6) AS scaled, round(eff, 6) AS eff, coalesce(scaled >= 1, false) AND coalesce(eff >= 0.5, false) AS trend FROM t", S.BARS, S.IND, f"f AS (SELECT symbol, d, close, lead(close, 3) OVER ({S.W}) / close - 1 AS f, abs(lead(close, 3) OVER ({S.W}) - close) / nullif({S.ahead('sum(chg)', 1, 3)}, 0) AS eff FROM base), t AS (SELECT symbol, d, eff, abs(f / nullif(CASE WHEN {S.past('count(f)', 180)} >= 60 THEN {S.past('stddev_samp(f)', 180)} END, 0)) AS scaled FROM f)"),
}
ORACLE |= {f"ind_{n}": S.sql(SERIES_TABLE.format(n), S.BARS, S.IND) for n in I.from_bars()}
