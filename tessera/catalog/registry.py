"""Registry, queues, costs and reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tessera.catalog import sql as S
from tessera.catalog import studies
from tessera.catalog.operations import CLOSED, day, tests
from tessera.catalog.studies import BASE, SPECS, battery, sides_of
from tessera.operators import registry as R
from tessera.operators import walkforward
from tessera.functions import text
from tessera.operators import stats
from tessera.plans import admission, study
from tessera.sources import panels, state

NOW = "DATE '2001-08-01'"


def now():
    return F.lit("2001-08-01").cast("date")


def moment():
    return F.lit("2024-01-28 00:00:00").cast("timestamp")


def history(s, d):
    """A candidate a customer: each order is an entry of its status log."""
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "accepted").when(F.col("o_orderpriority") == "2-HIGH", "watch").otherwise("rejected")
    log = F.transform(F.sort_array(F.collect_list(F.struct(F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("k"), status.alias("status")))), lambda e: F.struct(e["status"].alias("status"), e["at"].alias("at")))
    h = panels.table(s, d, "orders").groupBy(F.col("o_custkey").alias("candidate")).agg(log.alias("status_log"), F.to_date(F.min("o_orderdate")).alias("first_tracked_at"), F.to_date(F.max("o_orderdate")).alias("last"))
    return h.select("candidate", "status_log", "first_tracked_at", (F.col("candidate") % 11 == 0).alias("dropped"), F.when(F.col("candidate") % 3 == 0, F.col("last")).alias("last_asked_at"))


def bounded_log(s, d):
    entry = F.struct(F.lit("watch").alias("status"), now().alias("at"))
    kept = R.appended(F.col("status_log"), entry, 5)
    return history(s, d).select("candidate", F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda e: e["status"]), ",").alias("statuses"))


def parts(s, d):
    return panels.table(s, d, "part")


def resolved(s, d):
    known = parts(s, d).select(F.col("p_name").alias("name"))
    key = F.col("p_partkey")
    asked = parts(s, d).select(F.when(key % 4 == 0, F.col("p_name")).when(key % 4 == 1, F.concat(F.lit(" "), F.upper("p_name"))).when(key % 4 == 2, R.short_id(F.col("p_name"))).otherwise(F.concat(F.col("p_name"), F.lit("?"))).alias("query"))
    return R.resolve(asked, known)


def signals(s, d):
    return panels.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("coin"), F.when(F.col("user_id") % 2 == 0, "long").otherwise("short").alias("direction"), F.col("ts").alias("pushed_at"))


def codes(s, d):
    replies = parts(s, d).select(F.col("p_partkey").alias("reply_id"), F.concat(F.lit("drop 201"), (F.col("p_partkey") % 10).cast("string"), F.lit("-"), F.lpad((F.col("p_partkey") * 7 % 40).cast("string"), 4, "0"), F.lit(", and 2016-0001; not 12016-00011")).alias("text"))
    return R.replied_codes(replies, walkforward.prune_codes(battery(s, d)).select("code", "candidate"))


def costs(s, d):
    prices = s.createDataFrame([("Brand#1", 1.0), ("Brand#12", 2.0), ("Brand#3", 4.0), ("Brand#4", 0.5)], "prefix string, price double")
    return R.call_costs(parts(s, d).select(F.col("p_brand").alias("model"), F.col("p_size").alias("tokens")), prices).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("tokens") * F.col("price")), 4).alias("cost"), F.first("price").alias("price"))


def usage(s, d):
    """Orders as calls of models, with tokens of four kinds."""
    prices = s.createDataFrame([("1", 2.0, 10.0), ("2-H", 1.0, 5.0), ("3", 0.5, 4.0), ("3-MEDIUM", 0.25, 2.0)], "prefix string, price_in double, price_out double")
    k = F.col("o_orderkey")
    calls = panels.table(s, d, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("model"), (k % 1000).alias("input"), (k % 77).alias("output"), (k % 400).alias("cache_write"), (k % 900).alias("cache_read"))
    return R.usage(R.call_costs(calls, prices)).select(F.coalesce("label", F.lit("TOTAL")).alias("label"), "calls", *(F.round(c, 6).alias(c) for c in ("cost", "per_call", "cache_ratio")))


def advised(s, d):
    gates = [F.col("n"), F.col("status"), F.col("p") < 0.1, F.col("ratio") / 20]
    share = F.when(F.col("by_symbol"), 0.8).otherwise(0.3), F.when(F.col("by_year"), 0.7).otherwise(0.2)
    return battery(s, d).withColumns({"advice": walkforward.keep_or_drop(*gates), "advice_reason": walkforward.advice_reason(*gates, F.col("excess"), *share, F.col("ratio"))})


def status_report(s, d):
    rows = R.status_report(battery(s, d).withColumn("dropped", F.col("candidate") % 31 == 0))
    return rows.select("section", "place", "n", "never", F.array_join(F.slice(F.col("names").cast("array<string>"), 1, 8), ",").alias("first_names"))


def triggers_in_words(s, d):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "c1_").when(F.col("p_partkey") % 3 == 1, "c9_").otherwise("own_"), F.col("p_partkey").cast("string"))
    asked = parts(s, d).select(name.alias("candidate"))
    static = s.createDataFrame([("c1", "funding is extreme"), ("c2", "a wide bar on a release day")], "family string, words string")
    return R.described_triggers(asked, static, asked.where("candidate LIKE '%7'").withColumn("words", F.concat(F.lit("specified as "), F.col("candidate"))))


def yearly_prune(s, d):
    advice = history(s, d).select("candidate", F.when(F.col("candidate") % 2 == 0, "drop").otherwise("keep").alias("advice"))
    return R.yearly_prune(history(s, d), advice, now(), 2000)


def migrated(s, d):
    entries = history(s, d).withColumn("spec", F.concat(F.lit("spec "), F.col("candidate").cast("string"))).withColumn("first_tracked_at", F.when(F.col("candidate") % 7 != 0, F.col("first_tracked_at")))
    log = state.migrated_history(entries).select("candidate", F.array_join(F.transform("status_log", lambda e: F.concat_ws("@", e["status"], e["at"])), ",").alias("log"))
    return state.migrated_registry(entries).select("candidate", F.col("spec.spec").alias("spec"), "status", "registered_at").join(log, "candidate")


def proposals(s, d):
    """Answers with two, one or no proposal, as documents."""
    k = F.col("p_partkey")
    spec = lambda n: F.concat(F.lit('{"label": "'), F.lit(n), k.cast("string"), F.lit('", "direction": "long", "clauses": [{"indicator": "rsi_14d", "op": "<", "threshold": '), (k % 50).cast("string"), F.lit("}]}"))
    action = F.when(k % 5 == 0, "wait").otherwise("propose")
    body = F.when(k % 3 == 0, F.concat(F.lit('"spec": '), spec("one"))).when(k % 3 == 1, F.concat(F.lit('"specs": ['), spec("x"), F.lit(", "), spec("y"), F.lit(", "), spec("z"), F.lit("]"))).otherwise(F.lit('"spec": null'))
    rows = parts(s, d).select(k, F.concat(F.lit('{"action": "'), action, F.lit('", '), body, F.lit("}")).alias("doc"))
    return rows.select("p_partkey", F.explode(admission.proposed(F.col("doc"))).alias("x")).select("p_partkey", "x.label", F.col("x.clauses")[0]["threshold"].alias("threshold"))


def coins(s, d):
    k = F.col("n_nationkey")
    written = F.when(k % 4 == 0, F.lower("n_name")).when(k % 4 == 1, F.concat(F.lit(" "), F.col("n_name"), F.lit("usdt "))).when(k % 4 == 2, F.col("n_name")).otherwise(F.concat(F.col("n_name"), F.lit("x")))
    known = ["FRANCEUSDT", "GERMANYUSDT", "CHINAUSDT", "BRAZILUSDT", "CANADAUSDT", "ALGERIAUSDT", "NATION_0USDT", "NATION_1USDT", "NATION_2USDT"]
    return panels.table(s, d, "nation").select("n_nationkey", admission.normal_coin(written, known).alias("coin"))


def texts(s, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "```json\n{a < b & c > d} ").otherwise("a <b> & token-"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, "\n```").otherwise(" secret-7"))
    return parts(s, d).select("p_partkey", text.escaped(raw).alias("escaped"), text.unfenced(raw).alias("unfenced"), text.masked(raw, "secret-7", "token-").alias("masked"))


def required(s, d):
    """Candidates of the live tests with the events that their power asks for, none where no deviation is known."""
    sds = battery(s, d).select(F.concat(F.lit("c"), F.col("candidate").cast("string")).alias("candidate"), (F.col("ratio") / 10).alias("sd"))
    return tests(s, d).groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).join(sds, "candidate", "left").select("candidate", "n", F.round(walkforward.required_n(F.col("sd")), 4).alias("needed"))


def sweep(s, d):
    b = walkforward.benjamini_hochberg(battery(s, d), by=["brand"]).groupBy("brand")
    return b.agg(F.count("p").alias("family"), F.count_if(F.col("p") < 0.1).alias("raw_hits"), F.count_if("survives").alias("survivors"), F.round(F.avg((F.col("excess") > 0).cast("double")), 6).alias("positive"), F.round(F.median("excess"), 6).alias("median_excess"))


def paired(s, d):
    """Two raters of every order: how often they agree, and how far apart they are."""
    o = panels.table(s, d, "orders").select(F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 5).alias("a"), (F.col("o_custkey") % 5).alias("b"), ((F.col("o_orderkey") * 13 + F.col("o_custkey")) % 101 / 100.0).alias("overlap"))
    return o.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("same"), F.round(F.avg("overlap"), 6).alias("mean"), F.round(F.median("overlap"), 6).alias("median"), F.count_if(F.col("overlap") >= 0.5).alias("half"), F.count_if(F.col("overlap") == 0).alias("none"))


def confirmation(s, d):
    t = tests(s, d).where("status = 'closed'").groupBy("candidate")
    n = F.count(F.lit(1))
    return t.agg(n.alias("n"), F.greatest(F.lit(0), F.lit(20) - n).alias("needed"), F.round(F.avg((F.col("forward_return") > 0).cast("double")), 6).alias("positive"), F.round(F.avg("mfe"), 6).alias("mean_mfe"), F.round(F.avg("mae"), 6).alias("mean_mae"))


def latest_tests(s, d):
    closed = F.col("status") == "closed"
    return tests(s, d).groupBy("candidate").agg(F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), F.max(F.when(closed, F.struct("entry_d", "coin"))).alias("last")).select("candidate", "closed", "open", F.col("last.entry_d").alias("last_d"), F.col("last.coin").alias("last_coin"))


#: A year of Mondays, as of each of which the battery is judged.
WEEKS = [date(1999, 1, 4) + timedelta(weeks=k) for k in range(52)]


def weekly(s, d):
    """The verdicts of a year's weekly replay, all days in one plan."""
    found = study.run(panels.bars_1d(s, d), SPECS, WEEKS, sides=sides_of(s, d), with_static=True)
    return found.select("as_of", "candidate", "n", "mean", "baseline_mean", "p", "sortino", "ratio", "status", "fdr_significant")


QUERIES = {
    "evt_market_return_short": lambda s, d: R.market_return(panels.bars_1d(s, d), panels.literal_days(s), 7, "short").select("day", F.round("market", 6).alias("market")),
    "wf_without_nan": lambda s, d: walkforward.without_nan(battery(s, d).select("candidate", F.when(F.col("candidate") % 3 == 0, float("nan")).otherwise(F.col("ratio")).alias("ratio"))).select("candidate", F.round("ratio", 6).alias("ratio")),
    "stm_required_n": required,
    "sca_texts": texts,
    "cnd_normal_coin": coins,
    "cnd_proposals": proposals,
    "snk_migrate": migrated,
    "stm_yearly_prune": yearly_prune,
    "stm_described_triggers": triggers_in_words,
    "agg_prune_digest": lambda s, d: R.prune_digest(walkforward.prune_codes(advised(s, d))).select("place", "section", "code", "line"),
    "agg_status_report": status_report,
    "wf_advice_reason": lambda s, d: advised(s, d).select("candidate", "advice", "advice_reason"),
    "agg_usage_cost": usage,
    "wf_battery_weekly": weekly,
    "wf_battery": lambda s, d: study.run(panels.bars_1d(s, d), SPECS, sides=sides_of(s, d), with_static=True).select("candidate", "n", "mean", "baseline_mean", "p", "p_two_sided", "sortino", "ratio", "status", "reason", "advice", "fdr_significant"),
    "stm_status_latest": lambda s, d: R.latest_status(history(s, d)).withColumnRenamed("at", "updated"),
    "stm_status_append": bounded_log,
    "stm_prune_due": lambda s, d: R.prune_due(history(s, d), now()).select("candidate", F.round("years", 6).alias("years")),
    "stm_resolve_name": resolved,
    "stm_manual_signals": lambda s, d: R.active_signals(signals(s, d), moment()).select("coin", "direction", "id"),
    "stm_code_replies": codes,
    "stm_retention": lambda s, d: R.retention(signals(s, d).withColumnRenamed("pushed_at", "sent_at"), moment()).groupBy("coin", "fate").agg(F.count(F.lit(1)).alias("n")),
    "stm_resume_by_label": lambda s, d: parts(s, d).select(F.col("p_partkey").alias("label")).join(panels.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("label")), "label", "left_anti"),
    "vin_recent_releases": lambda s, d: R.recent_releases(panels.macro_vintage(s, d), F.date_sub(day(), 60), day()),
    "vin_number_text": lambda s, d: panels.table(s, d, "customer").select("c_custkey", R.number_text(F.floor(F.col("c_acctbal") * 4) / 4 / F.when(F.col("c_custkey") % 2 == 0, 100).otherwise(1), True).alias("shown")),
    "evt_market_return": lambda s, d: R.market_return(panels.bars_1d(s, d), panels.literal_days(s), 7).select("day", F.round("market", 6).alias("market")),
    "agg_usage_prefix_price": costs,
    "agg_sweep_score": sweep,
    "agg_paired_agreement": paired,
    "agg_confirmation": confirmation,
    "agg_latest_tests": latest_tests,
    "agg_best_epoch": lambda s, d: parts(s, d).groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best")),
    "agg_pooled_median": lambda s, d: tests(s, d).where("status = 'closed'").groupBy("candidate", "coin").agg(F.avg("forward_return").alias("m")).groupBy("candidate").agg(F.round(F.median("m"), 6).alias("pooled")),
}

HISTORY = "entry AS (SELECT o_custkey AS candidate, CAST(o_orderdate AS DATE) AS updated, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '2-HIGH' THEN 'watch' ELSE 'rejected' END AS status FROM orders)"
ASKED = "known AS (SELECT DISTINCT p_name AS name FROM part), asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN ' ' || upper(p_name) WHEN 2 THEN substr(sha256(p_name), 1, 4) ELSE p_name || '?' END AS query FROM part)"
FAMILY = "fam AS (SELECT candidate, brand, p, row_number() OVER (PARTITION BY brand ORDER BY p) AS rk, count(*) OVER (PARTITION BY brand) AS m FROM battery WHERE p IS NOT NULL), cut AS (SELECT brand, max(p) FILTER (p <= 0.05 * rk / m) AS cut FROM fam GROUP BY 1)"
ORACLE = {
    "evt_market_return_short": S.sql("SELECT day, round(-avg(exit / open - 1), 6) AS market FROM (SELECT symbol, day, arg_min(open, d) AS open, arg_min_null(exit, d) AS exit FROM (SELECT symbol, d, open, lead(close, 7) OVER (PARTITION BY symbol ORDER BY d) AS exit FROM bars) b JOIN (SELECT unnest([DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16']) AS day) ON b.d >= day GROUP BY 1, 2) WHERE open > 0 AND exit IS NOT NULL GROUP BY 1", S.BARS),
    "wf_without_nan": S.sql("SELECT candidate, round(CASE WHEN candidate % 3 <> 0 THEN ratio END, 6) AS ratio FROM battery", S.BATTERY),
    "stm_required_n": S.sql("SELECT t.candidate, t.n, round(CASE WHEN b.ratio > 0 THEN 6.0 * pow((1.645 + 0.84) * (b.ratio / 10) / 0.05, 2) END, 4) AS needed FROM (SELECT candidate, count(*) AS n FROM tests GROUP BY 1) t LEFT JOIN battery b ON t.candidate = 'c' || b.candidate", *BASE, S.TESTS, S.BATTERY),
    "sca_texts": "SELECT p_partkey, CASE WHEN e THEN '```json' || chr(10) || '{a &lt; b &amp; c &gt; d} ' || p_brand || chr(10) || '```' ELSE 'a &lt;b&gt; &amp; token-' || p_brand || ' secret-7' END AS escaped, CASE WHEN e THEN '{a < b & c > d} ' || p_brand ELSE 'a <b> & token-' || p_brand || ' secret-7' END AS unfenced, CASE WHEN e THEN '```json' || chr(10) || '{a < b & c > d} ' || p_brand || chr(10) || '```' ELSE 'a <b> & ***' || p_brand || ' ***' END AS masked FROM (SELECT *, p_partkey % 2 = 0 AS e FROM part)",
    "cnd_normal_coin": "SELECT n_nationkey, CASE WHEN full_ IN ('FRANCEUSDT', 'GERMANYUSDT', 'CHINAUSDT', 'BRAZILUSDT', 'CANADAUSDT', 'ALGERIAUSDT', 'NATION_0USDT', 'NATION_1USDT', 'NATION_2USDT') THEN full_ END AS coin FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN upper(n_name) || 'XUSDT' ELSE upper(n_name) || 'USDT' END AS full_ FROM nation)",
    "cnd_proposals": "SELECT p_partkey, label, CAST(p_partkey % 50 AS DOUBLE) AS threshold FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['one' || p_partkey] WHEN 1 THEN ['x' || p_partkey, 'y' || p_partkey] ELSE [] END) AS label FROM part WHERE p_partkey % 5 <> 0)",
    "snk_migrate": S.sql("SELECT candidate, 'spec ' || candidate AS spec, arg_max(status, (updated, k)) AS status, strftime(min(updated), '%Y-%m-%dT00:00:00+00:00') AS registered_at, string_agg(status || '@' || strftime(updated, '%Y-%m-%dT00:00:00+00:00'), ',' ORDER BY updated, k) AS log FROM entry WHERE candidate % 7 <> 0 GROUP BY 1", HISTORY),
    "stm_yearly_prune": S.sql(f"SELECT candidate FROM entry GROUP BY 1 HAVING candidate % 2 = 0 AND candidate % 11 <> 0 AND ({NOW} - min(updated)) / 365.25 >= 2 AND NOT bool_or(status = 'accepted') AND NOT (candidate % 3 = 0 AND {NOW} - max(updated) < 180)", HISTORY),
    "stm_described_triggers": "SELECT candidate, CASE WHEN candidate LIKE 'c1\\_%' ESCAPE '\\' THEN 'funding is extreme' WHEN candidate LIKE '%7' THEN 'specified as ' || candidate ELSE 'no definition found' END AS words FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'c1_' WHEN 1 THEN 'c9_' ELSE 'own_' END || p_partkey AS candidate FROM part)",
    "agg_status_report": S.sql("SELECT section, CAST(CASE section WHEN 'accepted' THEN 1 WHEN 'watch' THEN 2 WHEN 'insufficient_data' THEN 3 WHEN 'error' THEN 4 WHEN 'rejected' THEN 5 ELSE 6 END AS INTEGER) AS place, count(*) AS n, count(*) FILTER (n0 = 0) AS never, array_to_string(list_slice(list_sort(list(candidate) FILTER (n0 > 0)), 1, 8), ',') AS first_names FROM (SELECT candidate, n AS n0, CASE WHEN candidate % 31 = 0 THEN 'dropped' ELSE status END AS section FROM verdict) GROUP BY 1, 2", S.BATTERY, f"verdict AS (SELECT *, {S.STATUS} AS status FROM battery)"),
    "wf_advice_reason": S.sql("SELECT candidate, CASE WHEN status IN ('accepted', 'insufficient_data') OR n <= 20 OR coalesce(p < 0.1, false) THEN 'keep' WHEN need IS NOT NULL AND n >= need THEN 'drop' ELSE 'keep' END AS advice, CASE WHEN status = 'accepted' THEN 'accepted' WHEN status = 'insufficient_data' OR n <= 20 THEN 'only ' || n || ' events, not yet testable' WHEN coalesce(p < 0.1, false) THEN CASE WHEN coalesce(by_symbol, false) THEN 'significant, so far mostly on one symbol' WHEN coalesce(by_year, false) THEN 'significant, so far mostly in one year' WHEN ratio <= 1 THEN 'significant, but adverse moves outweigh favourable ones' ELSE 'significant, held back by a robustness check' END WHEN n >= need THEN 'had the power (' || n || ' of ' || format('{:,}', CAST(round_even(need, 0) AS BIGINT)) || ') and showed nothing, the effect runs ' || printf('%.1f', 100 * excess) || ' %' WHEN need IS NOT NULL THEN 'undetermined: ' || n || ' of ' || format('{:,}', CAST(round_even(need, 0) AS BIGINT)) || ' events' ELSE 'not enough is known' END AS advice_reason FROM (SELECT *, CASE WHEN ratio > 0 THEN 6.0 * pow((1.645 + 0.84) * (ratio / 20) / 0.05, 2) END AS need FROM verdict)", S.BATTERY, f"verdict AS (SELECT *, {S.STATUS} AS status FROM battery)"),
    "agg_usage_cost": "WITH priced AS (SELECT o_orderstatus AS label, o_orderkey % 1000 AS i, o_orderkey % 77 AS o, o_orderkey % 400 AS w, o_orderkey % 900 AS r, CASE WHEN o_orderpriority LIKE '1%' THEN 2.0 WHEN o_orderpriority LIKE '2-H%' THEN 1.0 WHEN o_orderpriority LIKE '3-MEDIUM%' THEN 0.25 WHEN o_orderpriority LIKE '3%' THEN 0.5 ELSE 0 END::DOUBLE AS pi, CASE WHEN o_orderpriority LIKE '1%' THEN 10.0 WHEN o_orderpriority LIKE '2-H%' THEN 5.0 WHEN o_orderpriority LIKE '3-MEDIUM%' THEN 2.0 WHEN o_orderpriority LIKE '3%' THEN 4.0 ELSE 0 END::DOUBLE AS po FROM orders) SELECT coalesce(label, 'TOTAL') AS label, count(*) AS calls, round(sum(c), 6) AS cost, round(sum(c) / count(*), 6) AS per_call, round(sum(r) / nullif(sum(r) + sum(w), 0), 6) AS cache_ratio FROM (SELECT *, (i * pi + w * pi * 1.25 + r * pi * 0.1 + o * po) / 1000000 AS c FROM priced) GROUP BY ROLLUP (label)",
    "stm_status_latest": S.sql("SELECT candidate, status, updated FROM entry QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY updated DESC, k DESC) = 1", HISTORY),
    "stm_status_append": S.sql("SELECT candidate, CAST(count(*) AS INTEGER) AS n, string_agg(status, ',' ORDER BY updated, k) AS statuses FROM (SELECT * FROM (SELECT candidate, updated, k, status FROM entry UNION ALL SELECT DISTINCT candidate, DATE '2099-01-01', 0, 'watch' FROM entry) QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY updated DESC, k DESC) <= 5) GROUP BY 1", HISTORY),
    "stm_prune_due": S.sql(f"SELECT candidate, round(({NOW} - min(updated)) / 365.25, 6) AS years FROM entry GROUP BY 1 HAVING candidate % 11 <> 0 AND ({NOW} - min(updated)) / 365.25 >= 2 AND NOT bool_or(status = 'accepted') AND NOT (candidate % 3 = 0 AND {NOW} - max(updated) < 180)", HISTORY),
    "stm_resolve_name": S.sql("SELECT query, coalesce(e.name, f.name, CASE WHEN i.n = 1 THEN i.name END) AS name, CAST(CASE WHEN coalesce(e.name, f.name) IS NOT NULL THEN 1 ELSE coalesce(i.n, 0) END AS BIGINT) AS matches FROM asked LEFT JOIN known e ON e.name = trim(query) LEFT JOIN (SELECT lower(name) AS l, max(name) AS name FROM known GROUP BY 1) f ON f.l = lower(trim(query)) LEFT JOIN (SELECT substr(sha256(name), 1, 4) AS l, count(*) AS n, max(name) AS name FROM known GROUP BY 1) i ON i.l = lower(trim(query))", ASKED),
    "stm_manual_signals": "SELECT event_type AS coin, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, event_id AS id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-28' QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY ts, event_id) = 1",
    "stm_code_replies": S.sql("SELECT reply_id, r.code, candidate FROM (SELECT p_partkey AS reply_id, unnest(['201' || (p_partkey % 10) || '-' || lpad(CAST(p_partkey * 7 % 40 AS VARCHAR), 4, '0'), '2016-0001']) AS code FROM part) r LEFT JOIN (SELECT candidate, CAST(year(first_tracked) AS VARCHAR) || '-' || lpad(CAST(row_number() OVER (PARTITION BY year(first_tracked) ORDER BY first_tracked, candidate) AS VARCHAR), 4, '0') AS code FROM battery) c USING (code)", S.BATTERY),
    "stm_retention": "SELECT event_type AS coin, CASE WHEN ts + INTERVAL 48 HOUR > TIMESTAMP '2024-01-28' THEN 'deleted' ELSE 'too_old' END AS fate, count(*) AS n FROM events GROUP BY 1, 2",
    "stm_resume_by_label": "SELECT p_partkey AS label FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "vin_recent_releases": S.sql("SELECT series, published, period, value, prior FROM (SELECT *, lead(value) OVER w AS prior, row_number() OVER w AS n FROM (SELECT r.series, r.published, v.period, arg_max(v.value, v.realtime_start) AS value FROM (SELECT DISTINCT series, realtime_start AS published FROM vintage WHERE realtime_start BETWEEN DATE '1998-06-30' - 60 AND DATE '1998-06-30') r JOIN vintage v ON v.series = r.series AND v.realtime_start <= r.published GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY series, published ORDER BY period DESC)) WHERE n = 1", S.VINTAGE),
    "vin_number_text": "SELECT c_custkey, CASE WHEN v >= 0 THEN '+' ELSE '' END || CASE WHEN abs(v) >= 10000 THEN format('{:,}', CAST(round_even(v / 1000, 0) AS BIGINT)) || 'k' WHEN abs(v) >= 100 OR v % 1 = 0 THEN format('{:,}', CAST(round_even(v, 0) AS BIGINT)) ELSE regexp_replace(printf('%.2f', v), '\\.?0+$', '') END AS shown FROM (SELECT c_custkey, floor(c_acctbal * 4) / 4 / CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 1 END AS v FROM customer)",
    "evt_market_return": S.sql("SELECT day, round(avg(exit / open - 1), 6) AS market FROM (SELECT symbol, day, arg_min(open, d) AS open, arg_min_null(exit, d) AS exit FROM (SELECT symbol, d, open, lead(close, 7) OVER (PARTITION BY symbol ORDER BY d) AS exit FROM bars) b JOIN (SELECT unnest([DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16']) AS day) ON b.d >= day GROUP BY 1, 2) WHERE open > 0 AND exit IS NOT NULL GROUP BY 1", S.BARS),
    "agg_usage_prefix_price": "SELECT model, count(*) AS calls, round(sum(tokens * price), 4) AS cost, any_value(price) AS price FROM (SELECT p_brand AS model, p_size AS tokens, CASE WHEN p_brand LIKE 'Brand#12%' THEN 2.0::DOUBLE WHEN p_brand LIKE 'Brand#1%' THEN 1.0::DOUBLE WHEN p_brand LIKE 'Brand#3%' THEN 4.0::DOUBLE WHEN p_brand LIKE 'Brand#4%' THEN 0.5::DOUBLE END AS price FROM part) GROUP BY 1",
    "agg_sweep_score": S.sql("SELECT b.brand, count(p) AS family, count(*) FILTER (p < 0.1) AS raw_hits, count(*) FILTER (coalesce(p <= cut, false)) AS survivors, round(avg(CAST(excess > 0 AS DOUBLE)), 6) AS positive, round(median(excess), 6) AS median_excess FROM battery b LEFT JOIN cut USING (brand) GROUP BY 1", S.BATTERY, FAMILY),
    "agg_paired_agreement": "SELECT o_orderstatus AS arm, count(*) AS n, round(avg(CAST(o_orderkey % 5 = o_custkey % 5 AS DOUBLE)), 6) AS same, round(avg(overlap), 6) AS mean, round(median(overlap), 6) AS median, count(*) FILTER (overlap >= 0.5) AS half, count(*) FILTER (overlap = 0) AS none FROM (SELECT *, CAST((o_orderkey * 13 + o_custkey) % 101 AS DOUBLE) / 100 AS overlap FROM orders) GROUP BY 1",
    "agg_confirmation": S.sql(f"SELECT candidate, count(*) AS n, greatest(0, 20 - count(*)) AS needed, round(avg(CAST(forward_return > 0 AS DOUBLE)), 6) AS positive, round(avg(mfe), 6) AS mean_mfe, round(avg(mae), 6) AS mean_mae FROM {CLOSED} GROUP BY 1", *BASE, S.TESTS),
    "agg_latest_tests": S.sql("SELECT candidate, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status <> 'closed') AS open, max(entry_d) FILTER (status = 'closed') AS last_d, arg_max(coin, (entry_d, coin)) FILTER (status = 'closed') AS last_coin FROM tests GROUP BY 1", *BASE, S.TESTS),
    "agg_best_epoch": "SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS best FROM part GROUP BY 1",
    "agg_pooled_median": S.sql(f"SELECT candidate, round(median(m), 6) AS pooled FROM (SELECT candidate, coin, avg(forward_return) AS m FROM {CLOSED} GROUP BY 1, 2) GROUP BY 1", *BASE, S.TESTS),
}
ORACLE["agg_prune_digest"] = f"""WITH advised AS ({ORACLE["wf_advice_reason"]}), coded AS ({studies.ORACLE["wf_prune_codes"]})
SELECT CASE WHEN advice = 'drop' THEN 1 ELSE 2 END AS place, advice AS section, code, concat_ws(': ', concat_ws(' ', code, CAST(candidate AS VARCHAR)), advice_reason) AS line FROM advised JOIN coded USING (candidate)"""
