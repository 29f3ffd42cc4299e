"""Conditions and static triggers on bars of hours; indicators of symbols cut by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import sql as S
from tessera.functions import slices
from tessera.functions.series import ahead, by_day, roll, rounded
from tessera.operators import indicators as I  # noqa: E741
from tessera.operators import live
from tessera.plans import admission
from tessera.plans import grammar as G
from tessera.plans.grammar import Clause, Spec
from tessera.sources import panels, state

NATIVE = [n for n in I.INDICATORS if n not in I.named("daily_native")]
#: One condition on each indicator of hours, then reaches, both directions of one, and ones that join hours and days.
SPECS = [
    Spec("return_1d", (Clause("close_return_1d", ">", 0.05),)),
    Spec("return_5d", (Clause("close_return_5d", "<", -0.05),)),
    Spec("volume", (Clause("volume_zscore_30d", ">=", 1.0),)),
    Spec("donchian", (Clause("donchian_pct_20d", "<", 0.3),)),
    Spec("bollinger", (Clause("bollinger_pctb_20d", ">=", 0.6),)),
    Spec("stochastic", (Clause("stochastic_k_14d", "<=", 40.0),)),
    Spec("funding", (Clause("funding_zscore_30d", ">", 0.5),)),
    Spec("macro", (Clause("is_macro_day", ">=", 1.0),)),
    Spec("volume_reach", (Clause("volume_zscore_30d", ">=", 1.5, 3), Clause("close_return_1d", "<", 0.0))),
    Spec("macro_reach", (Clause("is_macro_day", ">=", 1.0, 2), Clause("donchian_pct_20d", ">", 0.7)), coins=("click", "view")),
    Spec("days_and_hours", (Clause("rsi_14d", "<", 55.0, 1), Clause("bollinger_pctb_20d", "<", 0.5))),
    Spec("days_alone", (Clause("atr_pct_14d", ">", 0.0), Clause("daily_range_pct", ">=", 1.0, 1))),
]


def hours(s, d):
    """Bars of hours under the names of a panel: d is the hour."""
    return panels.bars_1h(s, d).withColumnRenamed("ts", "d")


def days_of_hours(s, d):
    by = hours(s, d).groupBy("symbol", F.to_date("d").alias("day"))
    days = by.agg(F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("volume").cast("double").alias("volume"))
    return days.withColumnRenamed("day", "d")


def panel_of_days(s, d):
    return I.complete(days_of_hours(s, d), panels.funding_of_events(s, d), panels.error_days(s, d))


def panel_of_hours(s, d, static=False):
    return I.complete(hours(s, d), panels.funding_of_events(s, d), panels.error_days(s, d), scale=24, daily=panel_of_days(s, d), static=static)


def static_hourly(s, d):
    return panel_of_hours(s, d, static=True).select("symbol", F.col("d").alias("ts"), *((F.col(n) == 1).alias(n) for n in I.STATIC))


def scan_hourly(s, d):
    """For each static condition, coin and day the first hour that fires, as a live scan looks at a day's hours."""
    flags = panel_of_hours(s, d, static=True).unpivot(["symbol", "d"], list(I.STATIC), "candidate", "fired").where("fired = 1")
    return flags.groupBy("candidate", F.col("symbol").alias("coin"), F.to_date("d").alias("day")).agg(F.min("d").alias("first_ts"), F.count(F.lit(1)).alias("n_hours"))


def cut_complete(s, d):
    """All indicators of days, of symbols cut into slices of 97 days."""
    df = I.complete(panels.bars_1d(s, d), panels.funding(s, d), panels.calendar(s, d), rows=97)
    return df.select("symbol", "d", "loc", "n_rows", *rounded(*I.from_bars(), "funding_zscore_30d", "rsi_14d", "atr_pct_14d"), "is_macro_day")


def cut_frames(s, d):
    """One frame of each kind over slices of 50 days: trailing, shifted, ahead, lags, any and all, percentile, carried and summed values."""
    df = slices.located(panels.bars_1d(s, d), 50)
    df = slices.summed(slices.filled(df.withColumn("last_rise", F.when(F.col("close") > F.col("open"), F.col("close"))), "last_rise", rows=50), {"volume_so_far": F.col("volume")}, rows=50)
    w = by_day

    def frames(x):
        past = w().rowsBetween(-40, -1)
        return x.withColumns({
            "mean_20": F.avg("close").over(roll(20)), "best_ahead": F.max("high").over(ahead(2, 22)), "lag_7": F.lag("close", 7).over(w()), "lead_3": F.lead("close", 3).over(w()),
            "any_rise": F.max(F.col("close") > F.col("open")).over(roll(5)), "all_rise": F.min(F.col("close") > F.col("open")).over(roll(3)), "p95": F.percentile("volume", F.lit(0.95)).over(past), "dev_past": F.stddev_samp("close").over(past),
        })

    made = slices.over_slices(df, frames, 40, 22, 50)
    return made.select("symbol", "d", "loc", "n_rows", "any_rise", "all_rise", *rounded("mean_20", "best_ahead", "lag_7", "lead_3", "p95", "dev_past", "last_rise", "volume_so_far"))


def tests_opened(s, d):
    """What putting each of the conditions to the test opens on each symbol."""
    hits = state.cut(G.occurrences_hourly(panel_of_hours(s, d), panel_of_days(s, d), SPECS).withColumnRenamed("label", "candidate"))
    return live.tests_opened(hits, panels.bars_1h(s, d), days_of_hours(s, d), 5, 7).withColumn("entry_price", F.round("entry_price", 6))


def registry(s, d):
    """Documents of specifications, good and bad, and a status for each, from the parts."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    clause = F.concat(F.lit('{"indicator": "'), F.when(k % 3 == 0, "cpi_surprise").otherwise("rsi_14d"), F.lit('", "op": "'), F.when(k % 11 == 0, "==").otherwise("<"), F.lit('", "threshold": '), text(F.col("p_size")), F.lit(', "within_days": '), text(k % 17), F.lit("}"))
    doc = F.concat(F.lit('{"label": "'), F.col("p_name"), F.lit('", "direction": "'), F.when(k % 13 == 0, "up").otherwise("long"), F.lit('", "clauses": ['), F.when(k % 19 == 0, "").otherwise(clause), F.lit("]}"))
    status = F.when(k % 7 == 0, "accepted").when(k % 5 == 0, "watch").otherwise("rejected")
    return panels.table(s, d, "part").select(k.alias("candidate"), F.when(k % 23 != 0, doc).alias("spec"), status.alias("status"))


def context_names(s, d):
    found = admission.context_names(registry(s, d))
    return found.select(F.size("accepted").alias("n_accepted"), F.md5(F.array_join("accepted", ",")).alias("accepted"), F.md5(F.array_join("not_accepted", ",")).alias("not_accepted"))


def latest_news(s, d):
    """The seven latest headlines, with the moment of publication as text."""
    events = panels.table(s, d, "events")
    at = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(7).select("event_id", F.upper("event_type").alias("headline"), at.alias("published_at"))


QUERIES = {
    "stm_tests_opened": tests_opened,
    "cnd_off_thesis": lambda s, d: admission.off_thesis(registry(s, d)),
    "agg_context_names": context_names,
    "src_news_latest": latest_news,
    "ind_hourly_all": lambda s, d: panel_of_hours(s, d).select("symbol", F.col("d").alias("ts"), *rounded(*(n for n in I.INDICATORS if not n.endswith("surprise")))),
    "cnd_hourly_all": lambda s, d: G.occurrences_hourly(panel_of_hours(s, d), panel_of_days(s, d), SPECS),
    "stm_static_hourly": static_hourly,
    "stm_scan_static_hourly": scan_hourly,
    "win_cut_indicators": cut_complete,
    "win_cut_frames": cut_frames,
}

DAYS = "dbars AS (SELECT symbol, CAST(ts AS DATE) AS d, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS DOUBLE) AS volume FROM hours GROUP BY 1, 2)"
RATE = "funding AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS d, avg(value) AS rate FROM events GROUP BY 1, 2)"
ERRORS = "days_of AS (SELECT CAST(ts AS DATE) AS d FROM events GROUP BY 1 HAVING 5 * count(*) FILTER (event_type = 'error') > count(*))"
RATED = f"rated AS (SELECT b.symbol, b.d, last_value(rate IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM bars b LEFT JOIN funding f ON b.symbol = f.symbol AND b.d = CAST(f.d AS TIMESTAMP)), fz AS (SELECT symbol, d, {S.z('rate', 720, 360)} AS funding_zscore_30d FROM rated)"
DAY_NATIVE = [n for n in I.INDICATORS if n in I.named("daily_native") and not n.endswith("surprise")]
WHOLE = f"""dwhole AS (SELECT dind.*, rsi_14d, atr_pct_14d FROM dind LEFT JOIN dwilder USING (symbol, d)),
hwhole AS (SELECT ind.* EXCLUDE ({', '.join(n for n in DAY_NATIVE if n in I.from_bars())}), efficiency_ratio_20d AS hourly_efficiency, funding_zscore_30d, CAST(CAST(ind.d AS DATE) IN (SELECT d FROM days_of) AS INTEGER) AS is_macro_day FROM ind LEFT JOIN fz USING (symbol, d)),
whole AS (SELECT h.*, {', '.join('x.' + n for n in DAY_NATIVE)} FROM hwhole h ASOF LEFT JOIN dwhole x ON x.symbol = h.symbol AND h.d >= x.d)"""
HOURLY = (S.HOURS, "bars AS (SELECT symbol, ts AS d, open, high, low, close, volume FROM hours)", DAYS, RATE, ERRORS, S.indicators(24), S.indicators(1, "dbars", "d"), S.wilder("dbars", "d"), RATED, WHOLE)


def clause_sql(c: Clause) -> str:
    hit = f"coalesce({c.indicator} {c.op} {c.threshold}, false)"
    return f"bool_or({hit}) OVER ({S.W} ROWS BETWEEN {c.within_days * (1 if c.indicator in DAY_NATIVE else 24)} PRECEDING AND CURRENT ROW)" if c.within_days else hit


CLAUSES = list(dict.fromkeys(c for x in SPECS for c in x.clauses))
OF_HOURS = [c for c in CLAUSES if c.indicator not in DAY_NATIVE]
OF_DAYS = [c for c in CLAUSES if c.indicator in DAY_NATIVE]
FIRED = f"""hfired AS (SELECT symbol, d, {', '.join(f'{clause_sql(c)} AS c{CLAUSES.index(c)}' for c in OF_HOURS)} FROM hwhole),
dfired AS (SELECT symbol, d, {', '.join(f'{clause_sql(c)} AS c{CLAUSES.index(c)}' for c in OF_DAYS)} FROM dwhole),
fired AS (SELECT h.*, {', '.join(f'coalesce(x.c{CLAUSES.index(c)}, false) AS c{CLAUSES.index(c)}' for c in OF_DAYS)} FROM hfired h ASOF LEFT JOIN dfired x ON x.symbol = h.symbol AND h.d >= x.d)"""
HITS = " UNION ALL ".join(f"SELECT '{x.label}' AS label, symbol, d AS ts FROM fired WHERE {' AND '.join(f'c{CLAUSES.index(c)}' for c in x.clauses)}" + (f" AND symbol IN {x.coins}" if x.coins else "") for x in SPECS)
STATIC = f"""static AS (SELECT symbol, d AS ts, coalesce(funding_zscore_30d < -2, false) AS c1_long, coalesce(funding_zscore_30d > 2, false) AS c1_short, wide AND close < open AS c2_long, wide AND close > open AS c2_short, strong AND coalesce(close_return_5d > 0, false) AS c6_long, strong AND coalesce(close_return_5d < 0, false) AS c6_short
 FROM (SELECT *, coalesce(range_pct > 1.5 * {S.roll('avg(range_pct)', 480)} AND {S.roll('count(range_pct)', 480)} >= 240, false) AND is_macro_day = 1 AS wide, coalesce(hourly_efficiency > 0.4 AND volume > 1.8 * {S.roll('avg(volume)', 480)} AND {S.roll('count(volume)', 480)} >= 240, false) AS strong FROM hwhole))"""
PAST = "OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)"
UPTO = "OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FRAMES = {
    "mean_20": S.roll("avg(close)", 20), "best_ahead": S.ahead("max(high)", 2, 22), "lag_7": f"lag(close, 7) OVER ({S.W})", "lead_3": f"lead(close, 3) OVER ({S.W})", "p95": f"quantile_cont(volume, 0.95) {PAST}", "dev_past": f"stddev_samp(close) {PAST}",
    "last_rise": f"last_value(CASE WHEN close > open THEN close END IGNORE NULLS) {UPTO}", "volume_so_far": f"sum(volume) {UPTO}",
}

REGISTRY = """registry AS (SELECT p_partkey AS candidate, p_partkey % 23 <> 0 AS doc, p_partkey % 19 <> 0 AS clause, p_partkey % 11 = 0 AS op, p_partkey % 17 AS within, p_partkey % 13 = 0 AS up, p_partkey % 3 = 0 AS news,
 CASE WHEN p_partkey % 7 = 0 THEN 'accepted' WHEN p_partkey % 5 = 0 THEN 'watch' ELSE 'rejected' END AS status FROM part)"""
OPENED = f"""hits AS ({HITS}), last AS (SELECT symbol, max(ts) AS last FROM hours GROUP BY 1),
since AS (SELECT label, h.symbol, min(ts) AS since FROM hits h JOIN last USING (symbol) WHERE ts >= last - INTERVAL 5 DAY GROUP BY 1, 2),
asked AS (SELECT l.label, last.symbol, since FROM (SELECT DISTINCT label FROM hits) l CROSS JOIN last LEFT JOIN since s ON s.label = l.label AND s.symbol = last.symbol),
opened AS (SELECT label AS candidate, symbol AS coin, since IS NOT NULL AS backdated, CASE WHEN since IS NULL THEN (SELECT max(d) FROM dbars b WHERE b.symbol = a.symbol) ELSE (SELECT min(d) FROM dbars b WHERE b.symbol = a.symbol AND CAST(d AS TIMESTAMP) > since) END AS entry_d FROM asked a)"""

ORACLE = {
    "stm_tests_opened": S.recursive("SELECT candidate, coin, entry_d, round(CASE WHEN backdated THEN b.open ELSE b.close END, 6) AS entry_price, CAST(7 AS INTEGER) AS horizon, backdated FROM opened JOIN dbars b ON b.symbol = coin AND b.d = entry_d", *HOURLY, FIRED, OPENED),
    "cnd_off_thesis": S.sql("SELECT * FROM (SELECT candidate, CASE WHEN NOT doc THEN 'no label' WHEN NOT clause THEN 'no clause' WHEN op THEN 'unknown operator' WHEN within > 14 THEN 'within_days is not in 0..14' WHEN up THEN 'unknown direction' WHEN NOT news THEN 'no clause on a published event' END AS reason FROM registry) WHERE reason IS NOT NULL", REGISTRY),
    "agg_context_names": S.sql("SELECT CAST(count(*) FILTER (status = 'accepted') AS INTEGER) AS n_accepted, md5(string_agg(CAST(candidate AS VARCHAR), ',' ORDER BY candidate) FILTER (status = 'accepted')) AS accepted, md5(string_agg(CAST(candidate AS VARCHAR), ',' ORDER BY candidate) FILTER (status <> 'accepted')) AS not_accepted FROM registry", REGISTRY),
    "src_news_latest": "SELECT event_id, upper(event_type) AS headline, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS published_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 7",
    "ind_hourly_all": S.recursive("SELECT symbol, d AS ts, " + ", ".join(f"round({n}, 6) AS {n}" for n in I.INDICATORS if not n.endswith("surprise")) + " FROM whole", *HOURLY),
    "cnd_hourly_all": S.recursive(HITS, *HOURLY, FIRED),
    "stm_static_hourly": S.recursive("SELECT * FROM static", *HOURLY, STATIC),
    "stm_scan_static_hourly": S.recursive("SELECT candidate, symbol AS coin, CAST(ts AS DATE) AS day, min(ts) AS first_ts, count(*) AS n_hours FROM (SELECT * FROM static UNPIVOT (fired FOR candidate IN (c1_long, c1_short, c2_long, c2_short, c6_long, c6_short))) WHERE fired GROUP BY 1, 2, 3", *HOURLY, STATIC),
    "win_cut_indicators": S.recursive(f"SELECT symbol, d, loc, n_rows, is_macro_day, {S.r(*I.from_bars(), 'funding_zscore_30d', 'rsi_14d', 'atr_pct_14d')} FROM whole", *S.ALL),
    "win_cut_frames": S.sql(f"SELECT symbol, d, row_number() OVER ({S.W}) - 1 AS loc, count(*) OVER (PARTITION BY symbol) AS n_rows, {S.roll('bool_or(close > open)', 5)} AS any_rise, {S.roll('bool_and(close > open)', 3)} AS all_rise, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in FRAMES.items()) + " FROM bars", S.BARS),
}
