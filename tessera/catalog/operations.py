"""Vintages, live tests, reports and queues."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import sql as S
from tessera.catalog.studies import BASE, HITS, SPECS, events, panel
from tessera.functions.series import rounded
from tessera.operators import events as E
from tessera.operators import live
from tessera.operators import registry as R
from tessera.operators import vintage as V
from tessera.plans.grammar import occurrences
from tessera.sources import panels, state


def day():
    return F.lit("1998-06-30").cast("date")


def tests(s, d):
    """Live tests made of events: a closed one has its outcome after seven bars."""
    ev = events(s, d)
    loc = F.col("entry_loc")
    return ev.select(F.concat(F.lit("c"), (loc % 5).cast("string")).alias("candidate"), F.col("symbol").alias("coin"), F.col("trigger_d").alias("entry_d"), F.when(loc % 11 == 0, "open").otherwise("closed").alias("status"), F.col("fwd_7").alias("forward_return"), F.col("mfe_7").alias("mfe"), F.abs("mae_7").alias("mae"), ((loc % 7) * F.lit(0.01) - 0.02).alias("baseline_return"))


def dated(s, d):
    """Live tests with a day of closing, seven days after the entry's."""
    return tests(s, d).withColumn("close_d", F.when(F.col("status") == "closed", F.date_add("entry_d", 7)))


def known(s, d):
    """What is on record of the candidates of the tests."""
    k = F.substring("candidate", 2, 1).cast("int")
    return tests(s, d).select("candidate").distinct().select("candidate", F.when(k % 2 == 0, k * 30).alias("prior"), (k == 3).alias("static"), (k == 4).alias("dropped"), F.when(k == 1, "accepted").otherwise("watch").alias("status"), F.when(k != 2, k / 100 + 0.02).alias("sd"))


def resolved(s, d):
    """Tests that open on every volume trigger, long ones on even rows, looked at on one day."""
    ev = events(s, d).where(F.col("trigger_d") <= day())
    entry = panel(s, d).select("symbol", "d", "loc")
    opened = ev.join(entry.withColumnRenamed("loc", "entry_loc"), ["symbol", "entry_loc"]).select(F.lit("volume").alias("candidate"), F.col("symbol").alias("coin"), F.col("d").alias("entry_d"), "entry_price", (F.col("entry_loc") % 3 + 5).cast("int").alias("horizon"), F.when(F.col("entry_loc") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return live.resolve(opened, panels.bars_1d(s, d), day()).select("coin", "entry_d", "status", "close_d", *rounded("forward_return", "mfe", "mae"))


def scan_open(s, d):
    """Hours of much trade as triggers of three candidates, of which one has open tests and one was dropped."""
    hits = panels.bars_1h(s, d).where("volume >= 3").select(F.col("symbol").alias("coin"), "ts", F.explode(F.array(*map(F.lit, ("a", "b", "c")))).alias("candidate"))
    opened = panels.bars_1h(s, d).select(F.lit("a").alias("candidate"), F.col("symbol").alias("coin")).distinct().where("coin < 'm'")
    return live.scan(hits, opened, s.createDataFrame([("c",)], "candidate string"), F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp"))


def ledger(s, d):
    """Compression exits as new entries, those of odd symbols' years before already in the ledger."""
    exits = E.compression_exits(panel(s, d), 1.0).select(F.col("symbol").alias("coin"), F.col("end_d").alias("exit_d"))
    new, kept = live.ledger(exits, exits.where(F.year("exit_d") % 2 == 0), F.lit("1999-06-30").cast("date"))
    return new.withColumn("kind", F.lit("new")).unionByName(kept.withColumn("kind", F.lit("kept")))


def promotion(s, d):
    part = panels.table(s, d, "part")
    parked = part.select(F.col("p_name").alias("label"), F.date_add(F.lit("2015-01-01").cast("date"), (F.col("p_partkey") * 37 % 3000).cast("int")).alias("proposed_at")).groupBy("label").agg(F.min("proposed_at").alias("proposed_at"))
    return live.promoted(parked, part.groupBy(F.col("p_name").alias("label")).agg(F.max(F.col("p_size") > 10).alias("testable")), day()).select("label")


def reveals(s, d):
    queue = panels.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("reveal_d"))
    arrived, waiting = state.due(queue, "reveal_d", day())
    return arrived.groupBy(F.lit("due").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.max("reveal_d").alias("last")).unionByName(waiting.groupBy(F.lit("waits").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.max("reveal_d").alias("last")))


def horizon_changes(s, d):
    part = panels.table(s, d, "part").select(F.col("p_partkey").alias("candidate"), F.col("p_size").alias("horizon"))
    return live.horizon_changes(part.where("candidate % 5 <> 0").withColumn("horizon", F.when(F.col("candidate") % 3 == 0, F.col("horizon") + 1).otherwise(F.col("horizon"))), part)


def flags(s, d):
    start = panels.table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("dropped"), F.lit(None).cast("date").alias("asked_at"))
    changes = panels.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", True)).alias("dropped"), F.to_date(F.max("o_orderdate")).alias("asked_at"))
    return state.with_flags(start, changes, "c_custkey", "dropped", "asked_at")


def monthly(s, d):
    t = tests(s, d).withColumn("month", F.date_format("entry_d", "yyyy-MM"))
    closed = F.col("status") == "closed"
    return t.groupBy("month").agg(F.count(F.lit(1)).alias("opened"), F.count_if(closed).alias("closed"), F.round(F.avg(F.when(closed, (F.col("forward_return") > 0).cast("double"))), 6).alias("positive"), F.round(F.try_divide(F.avg(F.when(closed, F.col("mfe"))), F.avg(F.when(closed, F.col("mae")))), 6).alias("ratio"))


def topk(s, d):
    t = tests(s, d).where("status = 'closed'").groupBy("candidate", "coin").agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return").alias("mean"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("coin").orderBy(F.abs(F.round("mean", 9)).desc(), "candidate"))).where("place <= 3").select("coin", "candidate", "n", F.round("mean", 6).alias("mean"), "place")


def usage(s, d):
    o = panels.table(s, d, "orders").rollup("o_orderpriority")
    return o.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("cost")).select(F.coalesce("o_orderpriority", F.lit("TOTAL")).alias("label"), "calls", "cost")


def scan_24h(s, d):
    h = panels.bars_1h(s, d)
    return h.select("symbol", "ts", live.fired_within(h, F.col("volume") >= 4, 24).alias("fired"))


QUERIES = {
    "vin_during": lambda s, d: V.during(panels.macro_vintage(s, d), F.lit("1997-03-01").cast("date"), day()).select("series", "published", "period", "value", F.round("delta", 4).alias("delta"), F.round("surprise", 6).alias("surprise")),
    "stm_queue_discard": lambda s, d: state.discard(panels.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), panels.table(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")), "id"),
    "stm_flags": flags,
    "stm_horizon_changes": horizon_changes,
    "stm_reveals": reveals,
    "stm_promotion": promotion,
    "stm_scan_open": scan_open,
    "stm_resolve": resolved,
    "agg_by_candidate_coin_topk": topk,
    "agg_pair_cooccurrence": lambda s, d: R.cooccurrence(occurrences(panel(s, d), SPECS)),
    "agg_top_with_note": lambda s, d: R.top_with_note(panels.table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")), F.col("mean").desc(), F.col("p_brand")).select("p_brand", "n", "mean", "place", F.col("left_out").cast("long").alias("left_out")),
    "agg_confirmation_rows": lambda s, d: R.confirmation_rows(dated(s, d), known(s, d)).select("candidate", F.col("confirmed").cast("long").alias("confirmed"), F.round("needed", 4).alias("needed"), "powered", F.round("trend", 6).alias("trend"), "status"),
    "agg_digest": lambda s, d: R.digest(dated(s, d), day()).select("opened", "resolved", "still_open", *rounded("positive", "mean", "ratio"), "resolved_ever", *rounded("positive_ever", "mean_ever")),
    "vin_asof_snapshot": lambda s, d: V.as_of(panels.macro_vintage(s, d), day()).select("series", "period", "value", "realtime_start"),
    "vin_first_print": lambda s, d: V.first_prints(panels.macro_vintage(s, d)),
    "vin_surprise": lambda s, d: V.surprises(panels.macro_vintage(s, d)).select("series", "published", F.round("surprise", 6).alias("surprise")),
    "vin_release_dates": lambda s, d: V.release_days(panels.macro_vintage(s, d), start=F.lit("1993-01-01").cast("date"), end=day()),
    "vin_new_period_dates": lambda s, d: V.release_days(panels.macro_vintage(s, d), new_periods_only=True),
    "vin_latest_with_prior": lambda s, d: V.latest_with_prior(panels.macro_vintage(s, d), day()),
    "agg_by_candidate_topk": lambda s, d: tests(s, d).where("status = 'closed'").groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("forward_return") > 0).cast("double")), 6).alias("positive"), F.round(F.avg("forward_return"), 6).alias("mean"), F.round(E.sortino(F.col("forward_return")), 6).alias("sortino")).orderBy(F.abs("mean").desc(), "candidate").limit(15),
    "agg_by_candidate": lambda s, d: tests(s, d).where("status = 'closed'").groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("forward_return") > 0).cast("double")), 6).alias("positive"), F.round(F.avg("forward_return"), 6).alias("mean")),
    "agg_monthly_digest": monthly,
    "agg_checkpoint": lambda s, d: live.checkpoint(tests(s, d), "candidate", "coin").select("candidate", "coin", "n", *rounded("win_rate", "adjusted_win_rate", "mean_excess", "mean_mfe", "mean_mae")),
    "agg_cooccurrence": lambda s, d: occurrences(panel(s, d), SPECS).groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")),
    "agg_usage_rollup": usage,
    "agg_pivot": lambda s, d: tests(s, d).groupBy("candidate").pivot("coin", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0),
    "agg_stale_crosscheck": lambda s, d: panels.table(s, d, "customer").join(panels.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("how")), "c_custkey", "left").select("c_custkey", F.when(F.col("last").isNull(), "missing").when(F.col("how") == "P", "failed").when(F.date_diff(F.lit("2001-08-01").cast("date"), F.to_date("last")) > 90, "stale").otherwise("fresh").alias("state")),
    "agg_recent_occurrences": lambda s, d: tests(s, d).orderBy(F.col("status"), F.col("entry_d").desc(), "coin").limit(8).select("candidate", "coin", "entry_d", "status"),
    "stm_scan_24h": scan_24h,
    "stm_one_open_per_key": lambda s, d: live.one_open_per_key(occurrences(panel(s, d), SPECS), ["label", "symbol"], 7),
    "stm_resolve_due": lambda s, d: tests(s, d).where("status = 'open'").select("candidate", "coin", "entry_d", F.date_add("entry_d", 7).alias("due_d")),
    "stm_ledger_dedup": ledger,
    "stm_ttl_queue": lambda s, d: panels.table(s, d, "events").where(F.col("ts") + F.expr("INTERVAL 48 HOURS") > F.lit("2024-01-28 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "stm_streak": lambda s, d: live.losing_streak(tests(s, d).where("status = 'closed'"), "candidate", ["entry_d", "coin"]),
    "stm_parked_stagger": lambda s, d: live.rota_due(panels.table(s, d, "part").select("p_name", "p_partkey"), "p_name", day()).select("p_partkey"),
    "stm_milestone": lambda s, d: tests(s, d).groupBy("candidate", "coin").agg(F.count(F.lit(1)).alias("c")).select("candidate", "coin", live.milestone(F.col("c"), F.lit(20)).alias("reached")),
    "stm_short_id": lambda s, d: panels.table(s, d, "part").select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 4).alias("short_id")),
    "stm_years_tracked": lambda s, d: panels.table(s, d, "orders").groupBy("o_custkey").agg(F.round(F.date_diff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))) / 365.25, 6).alias("years")),
}

CLOSED = "tests WHERE status = 'closed'"
ORACLE = {
    "vin_during": S.sql("SELECT m.series, m.published, m.period, m.value, round(m.delta, 4) AS delta, round(s.surprise, 6) AS surprise FROM moved m LEFT JOIN surprise s USING (series, published) WHERE published > DATE '1997-03-01' AND published <= DATE '1998-06-30'", S.SURPRISE),
    "stm_queue_discard": "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "stm_flags": "SELECT c_custkey, coalesce(f, CASE WHEN c_acctbal IS NOT NULL THEN c_acctbal > 0 END) AS dropped, asked_at FROM customer FULL JOIN (SELECT o_custkey AS c_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN true END AS f, CAST(max(o_orderdate) AS DATE) AS asked_at FROM orders GROUP BY 1) USING (c_custkey)",
    "stm_horizon_changes": "SELECT p_partkey AS candidate, CASE WHEN p_partkey % 5 <> 0 THEN p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END END AS was, p_size AS horizon FROM part WHERE p_size IS NOT NULL AND (p_partkey % 5 = 0 OR p_partkey % 3 = 0)",
    "stm_reveals": "SELECT CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-06-30' THEN 'due' ELSE 'waits' END AS state, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1",
    "stm_promotion": "SELECT label FROM (SELECT p_name AS label, min(DATE '2015-01-01' + CAST(p_partkey * 37 % 3000 AS INTEGER)) AS proposed_at, bool_or(p_size > 10) AS testable FROM part GROUP BY 1) WHERE testable AND (date_diff('day', DATE '1970-01-01', DATE '1998-06-30') + 719163 + ('0x' || substr(sha256(label), 1, 8))::BIGINT % 7) % 7 = 0 ORDER BY proposed_at, label LIMIT 1",
    "stm_scan_open": S.sql("SELECT candidate, symbol AS coin, min(ts) AS first_ts FROM hours, (SELECT unnest(['a', 'b']) AS candidate) WHERE volume >= 3 AND ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND NOT (candidate = 'a' AND symbol < 'm') GROUP BY 1, 2", S.HOURS),
    "stm_resolve": S.sql("SELECT symbol AS coin, entry_d, CASE WHEN last IS NOT NULL THEN 'closed' ELSE 'open' END AS status, CASE WHEN last IS NOT NULL THEN close_d END AS close_d, round(CASE WHEN last IS NOT NULL THEN sign * (last / entry_price - 1) END, 6) AS forward_return, round(CASE WHEN last IS NOT NULL THEN sign * (CASE WHEN sign > 0 THEN top ELSE bottom END / entry_price - 1) END, 6) AS mfe, round(CASE WHEN last IS NOT NULL THEN abs(CASE WHEN sign > 0 THEN bottom ELSE top END / entry_price - 1) END, 6) AS mae FROM (SELECT e.symbol, e.d AS entry_d, e.entry_price, e.sign, count(b.close) AS n, max(CASE WHEN b.loc = e.entry_loc + e.horizon THEN b.close END) AS last, max(b.d) AS close_d, max(b.high) AS top, min(b.low) AS bottom FROM (SELECT ev.*, i.d, ev.entry_loc % 3 + 5 AS horizon, CASE WHEN ev.entry_loc % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ev JOIN ind i ON i.symbol = ev.symbol AND i.loc = ev.entry_loc WHERE trigger_d <= DATE '1998-06-30') e LEFT JOIN ind b ON b.symbol = e.symbol AND b.loc > e.entry_loc AND b.loc <= e.entry_loc + e.horizon AND b.d <= DATE '1998-06-30' WHERE DATE '1998-06-30' - e.d >= e.horizon GROUP BY ALL)", *BASE),
    "agg_by_candidate_coin_topk": S.sql(f"SELECT coin, candidate, n, round(mean, 6) AS mean, CAST(row_number() OVER (PARTITION BY coin ORDER BY abs(round(mean, 9)) DESC, candidate) AS INTEGER) AS place FROM (SELECT candidate, coin, count(*) AS n, avg(forward_return) AS mean FROM {CLOSED} GROUP BY 1, 2) QUALIFY place <= 3", *BASE, S.TESTS),
    "agg_pair_cooccurrence": S.sql("SELECT p.label AS a, q.label AS b, count(*) AS both, (SELECT count(*) FROM hits h WHERE h.label = p.label) - count(*) AS only_a, (SELECT count(*) FROM hits h WHERE h.label = q.label) - count(*) AS only_b FROM hits p JOIN hits q USING (symbol, d) WHERE p.label < q.label GROUP BY 1, 2", S.BARS, S.IND, HITS),
    "agg_top_with_note": "SELECT p_brand, n, mean, CAST(row_number() OVER (ORDER BY mean DESC, p_brand) AS INTEGER) AS place, greatest(0, count(*) OVER () - 15) AS left_out FROM (SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1) QUALIFY place <= 15",
    "agg_confirmation_rows": S.sql("SELECT candidate, CAST(confirmed AS BIGINT) AS confirmed, round(needed, 4) AS needed, coalesce(confirmed >= needed, false) AS powered, round(trend, 6) AS trend, CASE WHEN k = 1 THEN 'accepted' ELSE 'watch' END AS status FROM (SELECT candidate, k, n + CASE WHEN k <> 3 AND k % 2 = 0 THEN k * 30 ELSE 0 END AS confirmed, CASE WHEN k <> 2 THEN 6.0 * pow((1.645 + 0.84) * (k / 100 + 0.02) / 0.05, 2) END AS needed, trend FROM (SELECT candidate, CAST(substr(candidate, 2, 1) AS INTEGER) AS k, count(*) AS n, avg(CAST(forward_return > 0 AS DOUBLE)) AS trend FROM tests WHERE status = 'closed' GROUP BY 1, 2)) WHERE k <> 4 ORDER BY confirmed DESC, candidate DESC LIMIT 8", *BASE, S.TESTS),
    "agg_digest": S.sql("SELECT count(*) FILTER (entry_d >= DATE '1998-06-30') AS opened, count(*) FILTER (c AND close_d >= DATE '1998-06-30') AS resolved, count(*) FILTER (status = 'open') AS still_open, round(avg(CAST(forward_return > 0 AS DOUBLE)) FILTER (c AND close_d >= DATE '1998-06-30'), 6) AS positive, round(avg(forward_return) FILTER (c AND close_d >= DATE '1998-06-30'), 6) AS mean, round(avg(mfe) FILTER (c AND close_d >= DATE '1998-06-30') / avg(abs(mae)) FILTER (c AND close_d >= DATE '1998-06-30'), 6) AS ratio, count(*) FILTER (c) AS resolved_ever, round(avg(CAST(forward_return > 0 AS DOUBLE)) FILTER (c), 6) AS positive_ever, round(avg(forward_return) FILTER (c), 6) AS mean_ever FROM (SELECT *, status = 'closed' AS c, entry_d + 7 AS close_d FROM tests)", *BASE, S.TESTS),
    "vin_asof_snapshot": S.sql("SELECT series, period, arg_max(value, realtime_start) AS value, max(realtime_start) AS realtime_start FROM vintage WHERE realtime_start <= DATE '1998-06-30' GROUP BY 1, 2", S.VINTAGE),
    "vin_first_print": S.sql("SELECT series, period, value, published FROM first_print", S.VINTAGE),
    "vin_surprise": S.sql("SELECT series, published, round(surprise, 6) AS surprise FROM surprise", S.SURPRISE),
    "vin_release_dates": S.sql("SELECT DISTINCT series, realtime_start AS d FROM vintage WHERE realtime_start BETWEEN DATE '1993-01-01' AND DATE '1998-06-30'", S.VINTAGE),
    "vin_new_period_dates": S.sql("SELECT DISTINCT series, published AS d FROM first_print", S.VINTAGE),
    "vin_latest_with_prior": S.sql("SELECT series, period, value, prior FROM (SELECT *, row_number() OVER w AS n, lead(value) OVER w AS prior FROM (SELECT series, period, arg_max(value, realtime_start) AS value FROM vintage WHERE realtime_start <= DATE '1998-06-30' GROUP BY 1, 2) WINDOW w AS (PARTITION BY series ORDER BY period DESC)) WHERE n = 1", S.VINTAGE),
    "agg_by_candidate_topk": S.sql("SELECT candidate, count(*) AS n, round(avg(CAST(forward_return > 0 AS DOUBLE)), 6) AS positive, round(avg(forward_return), 6) AS mean, round(avg(forward_return) / sqrt(avg(pow(least(forward_return, 0), 2))) * sqrt(252), 6) AS sortino FROM tests WHERE status = 'closed' GROUP BY 1 ORDER BY abs(mean) DESC, candidate LIMIT 15", *BASE, S.TESTS),
    "agg_by_candidate": S.sql(f"SELECT candidate, count(*) AS n, round(avg(CAST(forward_return > 0 AS DOUBLE)), 6) AS positive, round(avg(forward_return), 6) AS mean FROM {CLOSED} GROUP BY 1", *BASE, S.TESTS),
    "agg_monthly_digest": S.sql("SELECT strftime(entry_d, '%Y-%m') AS month, count(*) AS opened, count(*) FILTER (status = 'closed') AS closed, round(avg(CAST(forward_return > 0 AS DOUBLE)) FILTER (status = 'closed'), 6) AS positive, round(avg(mfe) FILTER (status = 'closed') / nullif(avg(mae) FILTER (status = 'closed'), 0), 6) AS ratio FROM tests GROUP BY 1", *BASE, S.TESTS),
    "agg_checkpoint": S.sql(f"SELECT candidate, coin, count(*) AS n, round(avg(CAST(forward_return > 0 AS DOUBLE)), 6) AS win_rate, round(avg(CAST(forward_return - baseline_return > 0 AS DOUBLE)), 6) AS adjusted_win_rate, round(avg(forward_return - baseline_return), 6) AS mean_excess, round(avg(mfe), 6) AS mean_mfe, round(avg(mae), 6) AS mean_mae FROM {CLOSED} GROUP BY 1, 2", *BASE, S.TESTS),
    "agg_cooccurrence": S.sql("SELECT k, count(*) AS n FROM (SELECT symbol, d, count(*) AS k FROM hits GROUP BY 1, 2) GROUP BY 1", S.BARS, S.IND, HITS),
    "agg_usage_rollup": "SELECT coalesce(o_orderpriority, 'TOTAL') AS label, count(*) AS calls, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "agg_pivot": S.sql("SELECT candidate, count(*) FILTER (coin = 'A') AS A, count(*) FILTER (coin = 'N') AS N, count(*) FILTER (coin = 'R') AS R FROM tests GROUP BY 1", *BASE, S.TESTS),
    "agg_stale_crosscheck": "SELECT c_custkey, CASE WHEN last IS NULL THEN 'missing' WHEN how = 'P' THEN 'failed' WHEN date_diff('day', CAST(last AS DATE), DATE '2001-08-01') > 90 THEN 'stale' ELSE 'fresh' END AS state FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS how FROM orders GROUP BY 1) USING (c_custkey)",
    "agg_recent_occurrences": S.sql("SELECT candidate, coin, entry_d, status FROM tests ORDER BY status, entry_d DESC, coin LIMIT 8", *BASE, S.TESTS),
    "stm_scan_24h": S.sql("SELECT symbol, ts, bool_or(volume >= 4) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS fired FROM hours", S.HOURS),
    "stm_one_open_per_key": S.recursive("SELECT label, symbol, d AS opened FROM walk", S.BARS, S.IND, HITS, "days AS (SELECT DISTINCT label, symbol, d FROM hits), walk AS (SELECT label, symbol, min(d) AS d FROM days GROUP BY 1, 2 UNION ALL SELECT w.label, w.symbol, (SELECT min(x.d) FROM days x WHERE x.label = w.label AND x.symbol = w.symbol AND x.d >= w.d + 7) AS d FROM walk w WHERE (SELECT min(x.d) FROM days x WHERE x.label = w.label AND x.symbol = w.symbol AND x.d >= w.d + 7) IS NOT NULL)"),
    "stm_resolve_due": S.sql("SELECT candidate, coin, entry_d, CAST(entry_d + INTERVAL 7 DAY AS DATE) AS due_d FROM tests WHERE status = 'open'", *BASE, S.TESTS),
    "stm_ledger_dedup": S.sql(f"SELECT symbol AS coin, d AS exit_d, kind FROM (SELECT symbol, d, 'new' AS kind FROM ex WHERE year(d) % 2 <> 0 UNION ALL SELECT symbol, d, 'kept' FROM ex WHERE DATE '1999-06-30' - d <= 365)", S.BARS, S.IND, f"ex AS (SELECT symbol, d FROM (SELECT *, lag(on_) OVER ({S.W}) AS was, {S.ahead('bool_or(on_)', 1, 5)} AS again, lead(d, 5) OVER ({S.W}) AS fifth FROM (SELECT *, coalesce(vol_compression_zscore >= 1.0, false) AS on_ FROM ind)) WHERE NOT on_ AND was AND NOT again AND fifth IS NOT NULL)"),
    "stm_ttl_queue": "SELECT event_type, count(*) AS n FROM events WHERE ts + INTERVAL 48 HOUR > TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1",
    "stm_streak": S.sql(f"SELECT candidate, count(*) AS streak FROM (SELECT candidate, sum(CAST(forward_return >= 0 AS INTEGER)) OVER (PARTITION BY candidate ORDER BY entry_d DESC, coin DESC) AS wins FROM {CLOSED}) WHERE wins = 0 GROUP BY 1 HAVING count(*) >= 2", *BASE, S.TESTS),
    "stm_parked_stagger": "SELECT p_partkey FROM part WHERE (date_diff('day', DATE '1970-01-01', DATE '1998-06-30') + 719163 + ('0x' || substr(sha256(p_name), 1, 8))::BIGINT % 7) % 7 = 0",
    "stm_milestone": S.sql("SELECT candidate, coin, CASE WHEN c // 20 * 20 > 20 THEN c // 20 * 20 END AS reached FROM (SELECT candidate, coin, count(*) AS c FROM tests GROUP BY 1, 2)", *BASE, S.TESTS),
    "stm_short_id": "SELECT p_partkey, substr(sha256(p_name), 1, 4) AS short_id FROM part",
    "stm_years_tracked": "SELECT o_custkey, round(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25, 6) AS years FROM orders GROUP BY 1",
}

QUERIES |= {
    "evt_backdated_entry": lambda s, d: live.first_fired(panels.bars_1h(s, d), (F.col("volume") >= 3) & (F.col("close") > F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-23, 0))), F.lit("2024-01-14 00:00:00").cast("timestamp"), F.lit("2024-01-28 00:00:00").cast("timestamp")),
    "jn_asof_ge": lambda s, d: live.first_bar_from(panels.bars_1d(s, d), panels.literal_days(s)).select("symbol", "day", "d", "open"),
    "jn_release_coverage": lambda s, d: functools.reduce(lambda df, n: live.covered_by_release(df, V.release_days(panels.macro_vintage(s, d)), n).withColumnRenamed("covered", f"within_{n}"), (3, 7, 10), panels.bars_1d(s, d)).select("symbol", "d", "within_3", "within_7", "within_10"),
    "jn_status_diff": lambda s, d: panels.table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("before")).join(panels.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_totalprice") > 200000).alias("now")), "c_custkey", "full").where(~F.col("before").eqNullSafe(F.col("now"))).select("c_custkey", "before", "now"),
}
ORACLE |= {
    "evt_backdated_entry": S.sql("SELECT symbol, min(ts) AS first_ts FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m FROM hours) WHERE volume >= 3 AND close > m AND ts > TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-28' GROUP BY 1", S.HOURS),
    "jn_asof_ge": S.sql("SELECT x.symbol, x.day, b.d, b.open FROM (SELECT DISTINCT symbol, day FROM bars, (SELECT unnest([DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16']) AS day)) x ASOF LEFT JOIN bars b ON b.symbol = x.symbol AND b.d >= x.day", S.BARS),
    "jn_release_coverage": S.sql("SELECT symbol, d, " + ", ".join(f"EXISTS (SELECT 1 FROM vintage v WHERE v.realtime_start <= bars.d AND v.realtime_start >= bars.d - {n}) AS within_{n}" for n in (3, 7, 10)) + " FROM bars", S.BARS, S.VINTAGE),
    "jn_status_diff": "SELECT c_custkey, before, now FROM (SELECT c_custkey, c_acctbal > 0 AS before FROM customer) FULL JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) > 200000 AS now FROM orders GROUP BY 1) USING (c_custkey) WHERE before IS DISTINCT FROM now",
}
