"""Conditions, joins, events, walk-forward evaluation and verdicts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalog import sql as S
from tessera.catalog.hourly import days_of_hours, hours
from tessera.functions import slices, text
from tessera.functions.series import HORIZONS, by_day, rounded
from tessera.operators import events as E
from tessera.operators import indicators as I  # noqa: E741
from tessera.operators import stats, walkforward
from tessera.operators import vintage as V
from tessera.operators.bitmaps import jaccard
from tessera.plans import study
from tessera.plans import grammar as G
from tessera.plans.grammar import Clause, Spec, enumerate_specs, loosened, occurrences
from tessera.sources import panels

VOLUME = Clause("volume_zscore_30d", ">=", 1.0)
SPECS = [
    Spec("volume", (VOLUME,)),
    Spec("volume_range", (VOLUME, Clause("range_zscore_30d", ">=", 0.5))),
    Spec("late_volume", (Clause("volume_zscore_30d", ">=", 1.5, 3), Clause("donchian_pct_20d", "<", 0.3))),
    Spec("narrow", (Clause("vol_compression_zscore", ">=", 1.0), Clause("close_return_1d", ">", 0.0, 2)), coins=("A", "R")),
]
SPEC_SQL = {"volume": "v1", "volume_range": "v1 AND coalesce(range_zscore_30d >= 0.5, false)", "late_volume": "v3 AND coalesce(donchian_pct_20d < 0.3, false)", "narrow": "coalesce(vol_compression_zscore >= 1.0, false) AND r2 AND symbol IN ('A', 'R')"}
HITS = f"lit AS (SELECT *, coalesce(volume_zscore_30d >= 1.0, false) AS v1, {S.roll('bool_or(coalesce(volume_zscore_30d >= 1.5, false))', 4)} AS v3, {S.roll('bool_or(coalesce(close_return_1d > 0, false))', 3)} AS r2 FROM ind), hits AS (" + " UNION ALL ".join(f"SELECT '{k}' AS label, symbol, d FROM lit WHERE {v}" for k, v in SPEC_SQL.items()) + ")"


def panel(s, d):
    return I.with_indicators(panels.bars_1d(s, d))


def events(s, d, direction="long"):
    return E.build_events(panel(s, d), VOLUME.column(), direction)


def complete(s, d):
    """All indicators of the registry, over the three series as price index, rate and claims."""
    sides = sides_of(s, d)
    return I.complete(panels.bars_1d(s, d), sides.funding, sides.days, sides.surprises, sides.series)


SERIES = {"cpi_surprise": "1-URGENT", "rate_surprise": "2-HIGH", "jobless_claims_surprise": "3-MEDIUM"}


def sides_of(s, d):
    return study.Sides(panels.funding(s, d), panels.calendar(s, d), V.surprises(panels.macro_vintage(s, d)), SERIES)


def static_triggers(s, d):
    sides = sides_of(s, d)
    df = I.complete(panels.bars_1d(s, d), sides.funding, sides.days, static=True)
    return df.select("symbol", "d", *((F.col(name) == 1).alias(name) for name in I.STATIC))


def relaxed(s, d):
    steps = [Spec(f"{x:.2f}", (loosened(Clause("volume_zscore_30d", ">=", 2.0), x),)) for x in (0.1, 0.25, 0.5)]
    return occurrences(panel(s, d), steps).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def ev_simulated(s, d, direction="long"):
    ev = events(s, d, direction)
    return E.simulate(ev, E.anchors(ev), [], direction=direction)


def grid(s, d, whole=False):
    """Of each fold's training events under all settings: the best setting, or all."""
    ev = events(s, d)
    levels = F.array_sort(F.collect_list(F.struct("h", F.col("mfe_anchor").alias("mfe"), F.col("mae_anchor").alias("mae"))))
    per = walkforward.training(E.long_form(ev), walkforward.folds(ev)).groupBy("fold").agg(levels.alias("levels"))
    results = E.grid_results(ev.withColumn("sign", F.lit(1)), per, [], ["symbol", "entry_loc"])
    rows = results.withColumn("sortino", E.grid_ratio()) if whole else E.best_setting(results, ["fold"])
    return rows.withColumn("win_rate", F.try_divide("wins", F.col("wins") + F.col("losses"))).select("fold", "tp", "sl", "n", *rounded("sortino", "win_rate"))


def one_evidence(s, d, spec):
    return study.evidence(complete(s, d), [spec])


def trigger_counts(s, d):
    """Of one specification the firings in and out of ordinary times, and its anchors over all events."""
    found = study.evidence(complete(s, d), [SPECS[0]])
    return found.counts.join(found.anchors, "k").select(F.lit("volume").alias("candidate"), "n_raw_triggers", "n_shock_excluded", "h", *rounded("mfe", "mae"))


NEWS_VOLUME = Spec("news_volume", (Clause("cpi_surprise", ">=", -0.5, 14), VOLUME))


def chosen(s, d):
    df, ev = panel(s, d), events(s, d)
    of = walkforward.folds(ev)
    base = walkforward.baseline(walkforward.forward_by_loc(df, HORIZONS), walkforward.spans(ev, of, test=False))
    return ev, of, walkforward.select_horizon(E.long_form(ev), of, base)


def oos(s, d):
    ev, of, h = chosen(s, d)
    return E.long_form(ev).join(h.select(F.col("fold").alias("period"), "h"), ["period", "h"])


def relax_until(s, d):
    specs = [Spec(f"t{x:g}", (Clause("volume_zscore_30d", ">=", x), Clause("range_zscore_30d", ">=", 0.2))) for x in (0.2, 0.8, 1.4, 2.0, 9.0)]
    found = G.relax_until_testable(panel(s, d), specs)
    return s.createDataFrame([(label, None if x is None else x[1], None if x is None else x[0].clauses[0].threshold) for label, x in found.items()], "label string, step double, threshold double")


#: 672 conditions, as many as a sweep of the grammar has.
SWEEP_VOLUME, SWEEP_PLACE = [round(-1.5 + 0.17 * k, 2) for k in range(24)], [round(0.02 + 0.035 * k, 3) for k in range(28)]


def sweep_pairs(s, d):
    specs = [Spec(f"{v}/{u}", (Clause("volume_zscore_30d", ">=", v), Clause("donchian_pct_20d", "<", u))) for v in SWEEP_VOLUME for u in SWEEP_PLACE]
    return jaccard(occurrences(panel(s, d), specs)).select("a", "b", "both", F.round("jaccard", 6).alias("jaccard"))


def redundancy(s, d):
    specs = [Spec("a", (VOLUME,)), Spec("b", (Clause("volume_zscore_30d", ">=", 1.1),)), Spec("c", (Clause("volume_zscore_30d", ">=", 2.2),)), Spec("d", (Clause("volume_zscore_30d", "<", -1.0),)), Spec("e", (Clause("volume_zscore_30d", "<=", -1.05),))]
    kept, dropped = G.distinct_proposals(panel(s, d), specs)
    return s.createDataFrame([(x.label, None) for x in kept] + list(dropped.items()), "label string, repeats string")


HOURLY = [Spec("native", (Clause("daily_range_pct", ">=", 1.0, 1),)), Spec("hours", (Clause("close_return_1d", ">", 0.0, 1),)), Spec("mixed", (Clause("daily_range_pct", ">=", 1.0), Clause("close_return_1d", "<", 0.0)))]


def hourly_native(s, d):
    return G.occurrences_hourly(I.complete(hours(s, d), scale=24), I.with_indicators(days_of_hours(s, d), ["daily_range_pct"]), HOURLY)


def described(s, d):
    """The specifications in words, by Spark's expressions from their documents, over a table of them."""
    kind = "label string, direction string, clauses array<struct<indicator:string,op:string,threshold:double,within_days:int>>"
    rows = s.createDataFrame([(x.to_json(),) for x in [*SPECS, NEWS_VOLUME]], "doc string").select(F.from_json("doc", kind).alias("x")).select("x.*")
    whole = F.transform("clauses", lambda c: F.struct(c["indicator"].alias("indicator"), c["op"].alias("op"), c["threshold"].alias("threshold"), F.coalesce(c["within_days"], F.lit(0)).alias("within_days")))
    return rows.select("label", text.described(whole, F.col("direction")).alias("text"))


#: Volume on any day: the second clause always holds, but its name keeps bars in a shock.
ALL_REGIMES = Spec("volume_any", (VOLUME, Clause("shock_zscore", ">", -99.0)))


def barrier_exit(s, d):
    """Positions of the trigger's bar, looked at ten days on: stop and target at 3 %, seven days at most."""
    later = panel(s, d).select("symbol", "d", "close", "high", "low", F.lag("d", 4).over(by_day()).alias("entry"), F.lag("close", 4).over(by_day()).alias("price"))
    up, down = E.barrier_prices(F.col("price"), F.lit(1), F.lit(0.5), F.lit(0.4))
    return later.where("entry IS NOT NULL").select("symbol", "d", E.expired(F.col("entry"), F.col("d"), 5, F.col("price"), F.col("high"), F.col("low"), down, up).alias("why"))


def incremental(s, d):
    df = panel(s, d)
    control = E.build_events(df, VOLUME.column())
    treated = E.build_events(df, SPECS[1].column()).select("symbol", "entry_loc")
    return control.join(treated, ["symbol", "entry_loc"], "left_anti").groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd_3"), 6).alias("mean"))


def unconditional(s, d):
    df, ev = panel(s, d), events(s, d)
    of = walkforward.folds(ev)
    return walkforward.baseline(walkforward.forward_by_loc(df, (3,)), walkforward.spans(ev, of, test=True)).select("fold", F.col("base_n").alias("n"), F.round(F.col("base_sum") / F.col("base_n"), 6).alias("mean"))


def bootstrap_lcg(s, d):
    """200 arithmetic draws of ten blocks of nine for each symbol: the same numbers in any engine."""
    own = Window.partitionBy("symbol")
    pool = walkforward.forward_by_loc(panel(s, d), (3,)).withColumn("k", F.row_number().over(own.orderBy("loc")) - 1).select("symbol", "k", "base")
    n = pool.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    draws = s.range(200).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")).join(n, F.lit(True))
    draws = draws.withColumn("s", ((F.col("b") * 7919 + F.col("j") * 104729 + 12345) * 48271 % 2147483647) % (F.col("n") - 8)).select("symbol", "b", F.explode(F.sequence(F.col("s"), F.col("s") + 8)).alias("k"))
    return draws.join(pool, ["symbol", "k"]).groupBy("symbol", "b").agg(F.avg("base").alias("m")).groupBy("symbol").agg(F.count(F.lit(1)).alias("reps"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"))


def bootstrap_p(s, d):
    df, ev = panel(s, d), events(s, d)
    pool = walkforward.forward_by_loc(df, (3,)).groupBy(F.col("symbol").alias("candidate")).agg(F.array_sort(F.collect_list(F.struct("loc", "base"))).alias("rows"))
    return walkforward.bootstrap_p(ev.select(F.col("symbol").alias("candidate"), F.col("fwd_3").alias("value"), F.lit(9).alias("block")), pool.select("candidate", F.lit(0).alias("chunk"), F.transform("rows", lambda r: r["base"]).alias("base")))


def battery(s, d):
    k = F.col("p_partkey")
    null_if = lambda m, x: F.when(k % m != 0, x)
    df = panels.table(s, d, "part").select(k.alias("candidate"), (k * 31 % 60).alias("n"), null_if(97, k * 7919 % 10007 / F.lit(10007.0) / F.when(k % 10 == 0, 2000.0).otherwise(1.0)).alias("p"), null_if(13, (k % 40 - 5) / F.lit(10.0)).alias("sortino"), (k % 17 != 0).alias("ok"), null_if(19, k % 5 == 0).alias("by_symbol"), null_if(23, k % 7 == 0).alias("by_year"), ((k % 30 - 8) / F.lit(100.0)).alias("excess"), null_if(29, (k % 25) / F.lit(12.0)).alias("ratio"), F.col("p_size").alias("weight"), F.col("p_brand").alias("brand"), F.date_add(F.lit("2015-01-01").cast("date"), (k * 37 % 3000).cast("int")).alias("first_tracked"))
    gates = [F.col(c) for c in ("n", "sortino", "ok", "by_symbol", "by_year")] + [F.col("p") < 0.1, F.col("excess"), F.col("ratio")]
    return df.withColumns({"status": walkforward.classify(*gates), "reason": walkforward.explain(*gates)})


REPORT = "count(*) AS n, count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome IN ('win', 'loss')), 0) AS win_rate, avg(net_return) / nullif(sqrt(avg(pow(least(net_return, 0), 2))), 0) * sqrt(252) AS sortino"
MET = "met AS (SELECT e.symbol, e.trigger_d, e.entry_loc, e.entry_price, o, b.high, b.low, b.n_rows, b.loc FROM (SELECT *, unnest(range(1, 23)) AS o FROM ev) e JOIN base b ON b.symbol = e.symbol AND b.loc = e.entry_loc + o)"
ANCHOR = "anchor AS (SELECT h, avg(mfe) AS f, avg(abs(mae)) AS a FROM long_ev GROUP BY 1)"
HIT = "hit AS (SELECT symbol, trigger_d, o, CASE WHEN low <= entry_price * (1 - a) THEN 'loss' WHEN high >= entry_price * (1 + f) THEN 'win' END AS outcome, CASE WHEN low <= entry_price * (1 - a) THEN -a - 0.002 WHEN high >= entry_price * (1 + f) THEN f - 0.002 END AS net FROM met JOIN anchor ON h = (SELECT min(x) FROM (SELECT unnest([1, 3, 7, 14, 21]) AS x) WHERE x >= o) WHERE o <= 21), first_hit AS (SELECT symbol, trigger_d, arg_min(outcome, o) AS outcome, arg_min(net, o) AS net FROM hit WHERE outcome IS NOT NULL GROUP BY 1, 2), ends AS (SELECT symbol, trigger_d, arg_min((high + low) / 2 / entry_price - 1 - 0.002, o) AS net FROM met WHERE o = 22 OR loc = n_rows - 1 GROUP BY 1, 2), trade AS (SELECT symbol, trigger_d, coalesce(f.outcome, 'timeout') AS outcome, coalesce(f.net, e.net) AS net_return FROM ends e LEFT JOIN first_hit f USING (symbol, trigger_d))"
SPAN = "span AS (SELECT fold, symbol, min(entry_loc) AS lo, max(entry_loc) AS hi FROM ev JOIN folds ON period {0} fold GROUP BY 1, 2), around AS (SELECT fold, f.* FROM forward_of f JOIN span USING (symbol) WHERE loc BETWEEN lo AND hi AND base IS NOT NULL)"
SCORE = "score AS (SELECT t.fold, t.h, (m - b) / nullif(sd, 0) AS score FROM (SELECT fold, h, avg(fwd) AS m, stddev_samp(fwd) AS sd FROM long_ev JOIN folds ON period < fold GROUP BY 1, 2) t JOIN (SELECT fold, h, avg(base) AS b FROM around GROUP BY 1, 2) USING (fold, h)), best AS (SELECT fold, h, score FROM score QUALIFY row_number() OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, h) = 1)"
GRID = """m AS (SELECT unnest([0.6, 0.8, 1.0, 1.2, 1.5])::DOUBLE AS x), combo AS (SELECT a.x AS tp, b.x AS sl FROM m a, m b),
train AS (SELECT fold, e.* FROM long_ev e JOIN folds ON period < fold), level AS (SELECT fold, h, avg(mfe) AS f, avg(abs(mae)) AS a FROM train GROUP BY 1, 2),
seen AS (SELECT DISTINCT fold, symbol, trigger_d FROM train),
hits_of AS (SELECT s.fold, tp, sl, symbol, trigger_d, o, CASE WHEN low <= entry_price * (1 - a * sl) THEN 'loss' WHEN high >= entry_price * (1 + f * tp) THEN 'win' END AS outcome, CASE WHEN low <= entry_price * (1 - a * sl) THEN -a * sl - 0.002 WHEN high >= entry_price * (1 + f * tp) THEN f * tp - 0.002 END AS net FROM seen s JOIN met USING (symbol, trigger_d) JOIN level l ON l.fold = s.fold AND l.h = CASE WHEN o <= 1 THEN 1 WHEN o <= 3 THEN 3 WHEN o <= 7 THEN 7 WHEN o <= 14 THEN 14 ELSE 21 END, combo WHERE o <= 21),
first_of AS (SELECT fold, tp, sl, symbol, trigger_d, arg_min(outcome, o) AS outcome, arg_min(net, o) AS net FROM hits_of WHERE outcome IS NOT NULL GROUP BY ALL),
ends AS (SELECT symbol, trigger_d, arg_min((high + low) / 2 / entry_price - 1 - 0.002, o) AS net FROM met WHERE o = 22 OR loc = n_rows - 1 GROUP BY 1, 2),
traded AS (SELECT s.fold, c.tp, c.sl, coalesce(outcome, 'timeout') AS outcome, coalesce(h.net, e.net) AS net_return FROM seen s JOIN ends e USING (symbol, trigger_d) CROSS JOIN combo c LEFT JOIN first_of h ON h.fold = s.fold AND h.tp = c.tp AND h.sl = c.sl AND h.symbol = s.symbol AND h.trigger_d = s.trigger_d)"""
TEST_YEAR = """pick AS (SELECT fold, tp, sl, n, sortino FROM (SELECT fold, tp, sl, {0} FROM traded GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(sortino, 9) DESC NULLS LAST, tp, sl) = 1),
own AS (SELECT DISTINCT p.fold, p.tp, p.sl, e.symbol, e.trigger_d FROM ev e JOIN pick p ON e.period = p.fold),
own_hits AS (SELECT w.symbol, w.trigger_d, m.o, CASE WHEN low <= entry_price * (1 - a * sl) THEN 'loss' WHEN high >= entry_price * (1 + f * tp) THEN 'win' END AS outcome, CASE WHEN low <= entry_price * (1 - a * sl) THEN -a * sl - 0.002 WHEN high >= entry_price * (1 + f * tp) THEN f * tp - 0.002 END AS net FROM own w JOIN met m USING (symbol, trigger_d) JOIN level l ON l.fold = w.fold AND l.h = CASE WHEN o <= 1 THEN 1 WHEN o <= 3 THEN 3 WHEN o <= 7 THEN 7 WHEN o <= 14 THEN 14 ELSE 21 END WHERE m.o <= 21),
own_first AS (SELECT symbol, trigger_d, arg_min(outcome, o) AS outcome, arg_min(net, o) AS net FROM own_hits WHERE outcome IS NOT NULL GROUP BY 1, 2)""".format(REPORT)
#: Events on any day whose shock score is known, and those near a release.
EV_ANY = S.EV.replace("WHERE coalesce(volume_zscore_30d >= 1.0, false) AND", "WHERE coalesce(volume_zscore_30d >= 1.0, false) AND shock_zscore IS NOT NULL AND")
EV_NEWS = S.EV.replace("ev AS (SELECT symbol,", "evx AS (SELECT recent, symbol,").replace(" FROM ind) WHERE", f", {S.roll('bool_or(coalesce(sp >= -0.5, false))', 15)} AS recent FROM (SELECT ind.*, s.surprise AS sp FROM ind LEFT JOIN (SELECT published, surprise FROM surprise WHERE series = '1-URGENT') s ON ind.d = s.published)) WHERE") + ", ev AS (SELECT * EXCLUDE (recent) FROM evx WHERE recent AND regime = 'normal')"
BASKETS = "p AS (SELECT symbol, d, close, dense_rank() OVER (ORDER BY d) AS k FROM bars), baskets AS (SELECT hh.h, x.d, avg(y.close / x.close - 1) AS basket FROM p x JOIN p y ON y.symbol = x.symbol JOIN (SELECT unnest([1, 3, 7, 14, 21]) AS h) hh ON y.k = x.k + hh.h GROUP BY 1, 2)"
RELATIVE = "long_rel AS (SELECT l.* REPLACE (l.fwd - coalesce(k.basket, 0) AS fwd) FROM long_ev l JOIN ind i ON i.symbol = l.symbol AND i.loc = l.entry_loc LEFT JOIN baskets k ON k.h = l.h AND k.d = i.d), forward_rel AS (SELECT f.* REPLACE (f.base - coalesce(k.basket, 0) AS base) FROM forward_of f JOIN ind i USING (symbol, loc) LEFT JOIN baskets k ON k.h = f.h AND k.d = i.d)"
#: Greedy episodes of (key, symbol, d): each opens so many days after the last one that did.
WALK = "walk AS (SELECT key, symbol, min(d) AS d FROM days GROUP BY 1, 2 UNION ALL SELECT w.key, w.symbol, (SELECT min(x.d) FROM days x WHERE x.key = w.key AND x.symbol = w.symbol AND x.d >= w.d + {0}) AS d FROM walk w WHERE (SELECT min(x.d) FROM days x WHERE x.key = w.key AND x.symbol = w.symbol AND x.d >= w.d + {0}) IS NOT NULL)"
LABELS = ", ".join(f"('{x.label}')" for x in SPECS)
REDUNDANT = " UNION ALL ".join(f"SELECT '{k}' AS label, symbol, d FROM ind WHERE volume_zscore_30d {c}" for k, c in (("a", ">= 1.0"), ("b", ">= 1.1"), ("c", ">= 2.2"), ("d", "< -1.0"), ("e", "<= -1.05")))
SWEEP = ", ".join(f"('{v}/{u}', {v}, {u})" for v in SWEEP_VOLUME for u in SWEEP_PLACE)
RELAXED = ", ".join(f"('t{t:g}', {x}, {round(t - t * x, 4)}, {round(0.2 - 0.2 * x, 4)})" for t in (0.2, 0.8, 1.4, 2.0, 9.0) for x in (0.0, 0.1, 0.25, 0.5))
CLAUSES = ", ".join(f"('{x.label}', '{x.direction}', {k}, '{c.indicator}', '{c.op}', {c.threshold}, {c.within_days})" for x in [*SPECS, NEWS_VOLUME] for k, c in enumerate(x.clauses))
HOUR = "PARTITION BY symbol ORDER BY ts"
SHORT_HIT = "anchor AS (SELECT h, avg(-mae) AS f, avg(abs(mfe)) AS a FROM long_ev GROUP BY 1), " + "hit AS (SELECT symbol, trigger_d, o, CASE WHEN high >= entry_price * (1 + a) THEN 'loss' WHEN low <= entry_price * (1 - f) THEN 'win' END AS outcome, CASE WHEN high >= entry_price * (1 + a) THEN -a - 0.002 WHEN low <= entry_price * (1 - f) THEN f - 0.002 END AS net FROM met JOIN anchor ON h = (SELECT min(x) FROM (SELECT unnest([1, 3, 7, 14, 21]) AS x) WHERE x >= o) WHERE o <= 21), first_hit AS (SELECT symbol, trigger_d, arg_min(outcome, o) AS outcome, arg_min(net, o) AS net FROM hit WHERE outcome IS NOT NULL GROUP BY 1, 2), ends AS (SELECT symbol, trigger_d, arg_min(1 - (high + low) / 2 / entry_price - 0.002, o) AS net FROM met WHERE o = 22 OR loc = n_rows - 1 GROUP BY 1, 2), trade AS (SELECT symbol, trigger_d, coalesce(f.outcome, 'timeout') AS outcome, coalesce(f.net, e.net) AS net_return FROM ends e LEFT JOIN first_hit f USING (symbol, trigger_d))"
EVENT_COLUMNS = [f"{k}_{h}" for h in HORIZONS for k in ("mfe", "mae", "fwd")]
BASE = (S.BARS, S.IND, S.EV)
VERDICT = f"verdict AS (SELECT *, {S.STATUS} AS status FROM battery)"
FAMILY = "fam AS (SELECT candidate, p, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM battery WHERE p IS NOT NULL {0}), cut AS (SELECT max(p) AS cut FROM fam WHERE p <= 0.05 * rk / m)"

QUERIES = {
    "flagship_event_study": lambda s, d: flagship(s, d),
    "cnd_clause": lambda s, d: panel(s, d).select("symbol", "d", VOLUME.column().alias("fired")),
    "cnd_within_days": lambda s, d: panel(s, d).select("symbol", "d", Clause("volume_zscore_30d", ">=", 1.5, 3).column().alias("fired")),
    "cnd_static_triggers": static_triggers,
    "cnd_occurrence_set": lambda s, d: occurrences(panel(s, d), SPECS),
    "cnd_count": lambda s, d: occurrences(panel(s, d), SPECS).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "cnd_episode_count": lambda s, d: E.greedy_episodes(occurrences(panel(s, d), SPECS), 21, "label").select("label", "symbol", F.col("n_episodes").cast("long").alias("n_episodes")),
    "cnd_testable": lambda s, d: G.testability(panel(s, d), SPECS).select("label", "n", "episodes", "testable", "reason"),
    "cnd_relax_until_testable": relax_until,
    "cnd_redundancy": redundancy,
    "cnd_jaccard_all": lambda s, d: jaccard(occurrences(panel(s, d), SPECS), all_pairs=True).select("a", "b", "both", F.round("jaccard", 6).alias("jaccard")),
    "cnd_control": lambda s, d: occurrences(complete(s, d), [Spec("whole", NEWS_VOLUME.clauses), Spec("state", NEWS_VOLUME.without_events().clauses)]),
    "cnd_hourly_native": hourly_native,
    "cnd_described": described,
    "cnd_sweep_jaccard": sweep_pairs,
    "cnd_jaccard": lambda s, d: jaccard(occurrences(panel(s, d), SPECS)).select("a", "b", F.round("jaccard", 6).alias("jaccard")),
    "cnd_relax_counts": relaxed,
    "cnd_grammar_enumerate": lambda s, d: s.createDataFrame([(x.label, len(x.clauses), x.direction) for x in enumerate_specs([Clause("volume_zscore_30d", ">=", float(t)) for t in (1, 2, 3)], [Clause("donchian_pct_20d", "<", 0.3), Clause("donchian_pct_20d", ">", 0.7)], [0, 3, 7])], "label string, n_clauses int, direction string").groupBy("direction", "n_clauses").agg(F.count(F.lit(1)).alias("n")),
    "cnd_spec_roundtrip": lambda s, d: s.createDataFrame([(Spec.from_json(x.to_json()).label, Spec.from_json(x.to_json()).describe()) for x in SPECS], "label string, text string"),
    "jn_pit_latest_revision": lambda s, d: V.as_of(panels.macro_vintage(s, d), F.lit("1998-06-30").cast("date")).select("series", "period", "value"),
    "jn_semi_calendar": lambda s, d: panels.bars_1d(s, d).join(panels.calendar(s, d), "d", "left_semi").select("symbol", "d", "close"),
    "jn_asof_next_bar": lambda s, d: panels.bars_1d(s, d).select("symbol", "d", F.lead("d").over(by_day()).alias("next_d"), F.lead("open").over(by_day()).alias("next_open")),
    "jn_ffill_daily_to_hourly": lambda s, d: slices.carried(panels.bars_1h(s, d).groupBy("symbol", F.date_add(F.to_date("ts"), 1).cast("timestamp").alias("t")).agg(F.max("close").alias("known")), panels.bars_1h(s, d).select("symbol", F.col("ts").alias("t")), "known").select("symbol", F.col("t").alias("ts"), "known"),
    "evt_build_events": lambda s, d: events(s, d).select("symbol", "trigger_d", F.col("entry_loc").cast("long").alias("entry_loc"), "entry_price", "regime", *rounded(*EVENT_COLUMNS)),
    "evt_regime_split": lambda s, d: events(s, d).groupBy("symbol").agg(F.count_if(F.col("regime") == "normal").alias("n_normal"), F.count_if(F.col("regime") == "shock").alias("n_shock")),
    "evt_basket": lambda s, d: E.basket(panels.bars_1d(s, d), 7).select("d", F.round("basket", 6).alias("basket")),
    "evt_market_adjust": lambda s, d: events(s, d).join(E.basket(panels.bars_1d(s, d), 7).withColumnRenamed("d", "trigger_d"), "trigger_d", "left").select("symbol", "trigger_d", F.round(E.market_adjusted(F.col("fwd_7"), F.col("basket")), 6).alias("adjusted")),
    "evt_market_adjust_short": lambda s, d: events(s, d, "short").join(E.basket(panels.bars_1d(s, d), 7).withColumnRenamed("d", "trigger_d"), "trigger_d", "left").select("symbol", "trigger_d", F.round(E.market_adjusted(F.col("fwd_7"), F.col("basket"), -1), 6).alias("adjusted")),
    "evt_simulate_short": lambda s, d: ev_simulated(s, d, "short").select("symbol", "trigger_d", "outcome", F.round("net_return", 6).alias("net_return")),
    "evt_anchors_normal": lambda s, d: E.anchors(events(s, d).where("regime = 'normal'")).select("h", *rounded("mfe_anchor", "mae_anchor")),
    "evt_barrier_exit": barrier_exit,
    "evt_anchors": lambda s, d: E.anchors(events(s, d)).select("h", *rounded("mfe_anchor", "mae_anchor")),
    "evt_elapsed_bucket": lambda s, d: s.range(1, 31).select("id", E.bucket_for(F.col("id")).alias("bucket")),
    "evt_simulate_trade": lambda s, d: ev_simulated(s, d).select("symbol", "trigger_d", "outcome", F.round("net_return", 6).alias("net_return")),
    "evt_report": lambda s, d: E.report(ev_simulated(s, d), "symbol").select("symbol", "n", *rounded("win_rate", "strict_win_rate", "sortino", "total_expectancy", "timeout_fraction")),
    "evt_compression_exit": lambda s, d: E.compression_exits(panel(s, d), 1.0).select("symbol", "start_d", "end_d", "confirmed_d", F.col("duration").cast("long").alias("duration"), *rounded("z_start", "z_end", "squeeze_return", "end_return")),
    "wf_barrier_grid_all": lambda s, d: grid(s, d, whole=True).select("fold", "tp", "sl", "n", *rounded("sortino", "win_rate")),
    "wf_oos_trades": lambda s, d: one_evidence(s, d, ALL_REGIMES).trades.select("symbol", "period", "trigger_d", "outcome", F.round("net_return", 6).alias("net_return")),
    "wf_params_log": lambda s, d: one_evidence(s, d, ALL_REGIMES).settings.select("fold", "tp", "sl", F.col("n").cast("long").alias("n"), F.round("sortino", 5).alias("sortino")),
    "wf_oos_ratio": lambda s, d: one_evidence(s, d, ALL_REGIMES).outcomes.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("mfe") / F.avg(F.abs("mae")), 6).alias("ratio")),
    "wf_incremental_pool": lambda s, d: one_evidence(s, d, NEWS_VOLUME).pool.select("chunk", F.size("base").cast("long").alias("n"), F.round(F.aggregate("base", F.lit(0.0), lambda a, x: a + x) / F.size("base"), 6).alias("mean")),
    "wf_relative_outcomes": lambda s, d: one_evidence(s, d, dataclasses.replace(ALL_REGIMES, outcome="market_relative")).outcomes.select("symbol", "trigger_d", "h", F.round("value", 6).alias("value")),
    "wf_trigger_counts": trigger_counts,
    "wf_folds": lambda s, d: walkforward.folds(events(s, d)),
    "wf_barrier_grid": grid,
    "wf_horizon_select": lambda s, d: chosen(s, d)[2].select("fold", "h", F.round("score", 6).alias("score")),
    "wf_oos_returns": lambda s, d: oos(s, d).select("symbol", "trigger_d", "period", "h", F.round("fwd", 6).alias("fwd")),
    "wf_baseline_incremental": incremental,
    "wf_baseline_unconditional": unconditional,
    "wf_bootstrap_lcg": bootstrap_lcg,
    "wf_bootstrap_p": bootstrap_p,
    "wf_concentration": lambda s, d: walkforward.concentration(events(s, d), ["period"], "symbol", "fwd_7").select("period", F.round("max_share", 6).alias("max_share"), "dominant", "concentrated"),
    "wf_classify": lambda s, d: battery(s, d).select("candidate", "status"),
    "wf_explain": lambda s, d: battery(s, d).select("candidate", "reason"),
    "wf_bh": lambda s, d: walkforward.benjamini_hochberg(battery(s, d)).select("candidate", "survives"),
    "wf_bh_weighted": lambda s, d: walkforward.benjamini_hochberg(battery(s, d), weight="weight", by=["brand"]).select("candidate", "survives"),
    "wf_fdr_demotion": lambda s, d: walkforward.demote(battery(s, d)).groupBy("status", "fdr_demoted").agg(F.count(F.lit(1)).alias("n")),
    "wf_required_n": lambda s, d: battery(s, d).select("candidate", F.round(walkforward.required_n(F.col("ratio") / 10), 4).alias("n")),
    "wf_prune_codes": lambda s, d: walkforward.prune_codes(battery(s, d)).select("candidate", "code"),
    "stat_mann_whitney_small": lambda s, d: stats.mann_whitney(panels.table(s, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", ["o_custkey"]).select("o_custkey", "n1", "n2", F.round("u", 2).alias("u"), F.round("p", 6).alias("p")),
    "stat_mann_whitney": lambda s, d: stats.mann_whitney(I.with_inputs(panels.bars_1d(s, d)).where("ret IS NOT NULL"), "ret", F.dayofweek("d") == 2, ["symbol"]).select("symbol", "n1", "n2", F.round("u", 2).alias("u"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p")),
    "stat_fisher_exact": lambda s, d: s.range(1, 9).select("id", F.round(stats.fisher_one_sided(F.col("id"), F.lit(5), F.lit(3), F.col("id") + 4), 6).alias("p")),
    "stat_signed_rank": lambda s, d: stats.signed_rank(events(s, d).withColumn("x", F.round(F.col("fwd_7") - F.col("fwd_3"), 4)), "x", ["symbol"]).select("symbol", "n", F.round("w_plus", 2).alias("w_plus"), F.round("w_minus", 2).alias("w_minus"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p")),
}


def flagship(s, d):
    """A volume score of one or more with a low surprise in the seven days before: events by symbol and year."""
    df = I.with_indicators(panels.bars_by_region(s, d), ["volume_zscore_30d", "shock_zscore"])
    first = V.surprises(panels.macro_vintage(s, d)).where("series = '1-URGENT'").select(F.col("published").alias("d"), "surprise")
    df = df.join(first, "d", "left")
    ev = E.build_events(df, Spec("flagship", (VOLUME, Clause("surprise", "<=", -0.3, 7))).column())
    return ev.groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd_3"), 6).alias("mean_fwd_3"), F.round(F.avg("mfe_7"), 6).alias("mean_mfe_7"), F.round(F.avg("mae_7"), 6).alias("mean_mae_7"))


REASON = "'only ' || CAST(n AS VARCHAR) || ' of more than 20 events'"
REASONS = f"CASE WHEN n <= 20 THEN {REASON} WHEN sortino IS NULL THEN 'no trade result' WHEN NOT ok THEN 'pattern test did not run' WHEN by_symbol IS NULL OR by_year IS NULL THEN 'no positive group' WHEN by_symbol THEN 'one symbol carries it' WHEN by_year THEN 'one year carries it' WHEN excess <= 0 THEN 'no excess return' WHEN NOT coalesce(p < 0.1, false) THEN 'not better than its baseline' WHEN ratio IS NULL OR ratio <= 1 THEN 'adverse moves outweigh favourable ones' END"
LITERAL_SPECS = ", ".join(f"('{x.label}', '{x.describe()}')" for x in SPECS)

def tail_sql(z: str) -> str:
    """The share of a normal distribution above z, as `stats.normal_tail` approximates it."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    upper = f"exp(-({z}) * ({z}) / 2) / 2.5066282746310002::DOUBLE * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END"




def draw_sql(which: int) -> str:
    """The number in [0, 1) of replicate r and draw j that `walkforward.uniforms` makes."""
    whole = "18446744073709551616::UHUGEINT"
    x = f"((r::UHUGEINT * 8589934592 + j::UHUGEINT * 2 + {which} + {walkforward.STEP}::UHUGEINT) % {whole})"
    for shift, times in ((30, walkforward.FIRST), (27, walkforward.SECOND)):
        x = f"((xor({x}, {x} // {2**shift}) * {times}::UHUGEINT) % {whole})"
    return f"(CAST(xor({x}, {x} // {2**31}) // 2048 AS DOUBLE) / 9007199254740992)"


ORACLE = {
    "wf_relative_outcomes": S.sql("SELECT symbol, trigger_d, CAST(h AS INTEGER) AS h, round(fwd, 6) AS value FROM long_rel JOIN best USING (h) WHERE fold = period", S.BARS, S.IND, EV_ANY, S.LONG, S.FOLDS, S.FORWARD, BASKETS, RELATIVE, SPAN.format("<").replace("forward_of f", "forward_rel f"), SCORE.replace("long_ev", "long_rel")),
    "wf_incremental_pool": S.sql("SELECT CAST(fold AS VARCHAR) AS chunk, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT b.fold, CASE b.h " + " ".join(f"WHEN {h} THEN fwd_{h}" for h in HORIZONS) + " END AS v FROM evx x JOIN best b ON b.fold = x.period WHERE regime = 'normal' AND NOT recent) WHERE v IS NOT NULL GROUP BY 1", S.BARS, S.SURPRISE, S.IND, EV_NEWS, S.LONG, S.FOLDS, S.FORWARD, SPAN.format("<"), SCORE),
    "wf_oos_ratio": S.sql("SELECT CAST(period AS INTEGER) AS period, count(*) AS n, round(avg(fwd), 6) AS mean, round(avg(mfe) / avg(abs(mae)), 6) AS ratio FROM long_ev JOIN best USING (h) WHERE fold = period GROUP BY 1", S.BARS, S.IND, EV_ANY, S.LONG, S.FOLDS, S.FORWARD, SPAN.format("<"), SCORE),
    "wf_params_log": S.sql("SELECT CAST(fold AS INTEGER) AS fold, tp, sl, n, round(sortino, 5) AS sortino FROM pick", S.BARS, S.IND, EV_ANY, S.LONG, S.FOLDS, MET, GRID, TEST_YEAR),
    "wf_trigger_counts": S.sql("SELECT 'volume' AS candidate, (SELECT count(*) FROM ev WHERE regime = 'normal') AS n_raw_triggers, (SELECT count(*) FROM ev WHERE regime = 'shock') AS n_shock_excluded, CAST(h AS INTEGER) AS h, round(avg(l.mfe), 6) AS mfe, round(avg(abs(l.mae)), 6) AS mae FROM long_ev l JOIN (SELECT symbol, trigger_d, regime FROM ev) e USING (symbol, trigger_d) WHERE regime = 'normal' GROUP BY 4", *BASE, S.LONG),
    "wf_bootstrap_p": S.sql(f"""SELECT symbol AS candidate, n, mean, baseline_mean, baseline_n, p, p_two_sided, p < 0.1 AND mean > baseline_mean AS significant
 FROM (SELECT symbol, n, mean, baseline_mean, baseline_n, avg(CAST(m >= mean AS DOUBLE)) AS p, avg(CAST(abs(m - baseline_mean) >= abs(mean - baseline_mean) AS DOUBLE)) AS p_two_sided FROM
  (SELECT symbol, n, mean, baseline_mean, baseline_n, r, sum(hi.s - coalesce(lo.s, 0)) / n AS m FROM
   (SELECT *, least(9, n - 9 * j) AS take, CAST(floor(u * (baseline_n - 8)) AS BIGINT) AS start FROM
    (SELECT o.*, r, j, {draw_sql(1)} AS u FROM own o, range(2000) a(r), range(1000) b(j) WHERE 9 * j < n)) d
   JOIN pool hi ON hi.sym = d.symbol AND hi.k = d.start + d.take LEFT JOIN pool lo ON lo.sym = d.symbol AND lo.k = d.start GROUP BY symbol, n, mean, baseline_mean, baseline_n, r) GROUP BY symbol, n, mean, baseline_mean, baseline_n)""",
        *BASE, S.FORWARD, f"pool AS (SELECT symbol AS sym, row_number() OVER w AS k, sum(base) OVER w AS s, base FROM forward_of WHERE h = 3 AND base IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY loc)), own AS (SELECT symbol, n, mean, baseline_mean, baseline_n FROM (SELECT symbol, count(*) AS n, avg(fwd_3) AS mean FROM ev GROUP BY 1) JOIN (SELECT sym, avg(base) AS baseline_mean, count(*) AS baseline_n FROM pool GROUP BY 1) ON sym = symbol)"),
    "wf_oos_trades": S.sql("SELECT w.symbol, CAST(w.fold AS INTEGER) AS period, w.trigger_d, coalesce(f.outcome, 'timeout') AS outcome, round(coalesce(f.net, e.net), 6) AS net_return FROM own w JOIN ends e USING (symbol, trigger_d) LEFT JOIN own_first f USING (symbol, trigger_d)", S.BARS, S.IND, EV_ANY, S.LONG, S.FOLDS, MET, GRID, TEST_YEAR),
    "wf_barrier_grid_all": S.sql(f"SELECT CAST(fold AS INTEGER) AS fold, tp, sl, n, round(sortino, 6) AS sortino, round(win_rate, 6) AS win_rate FROM (SELECT fold, tp, sl, {REPORT} FROM traded GROUP BY 1, 2, 3)", *BASE, S.LONG, S.FOLDS, MET, GRID),
    "evt_barrier_exit": S.sql(f"SELECT symbol, d, CASE WHEN low <= price * (1 - 0.4::DOUBLE) THEN 'stop' WHEN high >= price * (1 + 0.5::DOUBLE) THEN 'target' WHEN d - entry >= 5 THEN 'time' END AS why FROM (SELECT *, lag(d, 4) OVER ({S.W}) AS entry, lag(close, 4) OVER ({S.W}) AS price FROM bars) WHERE entry IS NOT NULL", S.BARS),
    "evt_anchors_normal": S.sql("SELECT CAST(h AS INTEGER) AS h, round(avg(mfe), 6) AS mfe_anchor, round(avg(abs(mae)), 6) AS mae_anchor FROM long_ev l JOIN (SELECT symbol, trigger_d, regime FROM ev) e USING (symbol, trigger_d) WHERE regime = 'normal' GROUP BY 1", *BASE, S.LONG),
    "evt_simulate_short": S.sql("SELECT symbol, trigger_d, outcome, round(net_return, 6) AS net_return FROM trade", *BASE, S.LONG, MET, SHORT_HIT),
    "evt_market_adjust_short": S.sql("SELECT symbol, trigger_d, round(-fwd_7 + coalesce(basket, 0), 6) AS adjusted FROM ev LEFT JOIN baskets ON d = trigger_d AND h = 7", *BASE, BASKETS),
    "cnd_described": f"SELECT label, any_value(direction) || ' when ' || string_agg(replace(indicator, '_', ' ') || ' ' || CASE op WHEN '<' THEN 'below' WHEN '<=' THEN 'at most' WHEN '>' THEN 'above' ELSE 'at least' END || ' ' || printf('%.2f', threshold) || CASE WHEN reach > 0 THEN ' within ' || CAST(reach AS VARCHAR) || ' days' ELSE '' END, ' and ' ORDER BY k) AS text FROM (VALUES {CLAUSES}) t(label, direction, k, indicator, op, threshold, reach) GROUP BY 1",
    "cnd_hourly_native": S.sql(f"SELECT label, symbol, ts FROM (SELECT 'native' AS label, symbol, ts FROM h WHERE wide_1 UNION ALL SELECT 'hours', symbol, ts FROM h WHERE up_1 UNION ALL SELECT 'mixed', symbol, ts FROM h WHERE wide AND down)", S.HOURS, "dd AS (SELECT symbol, CAST(ts AS DATE) AS d, coalesce((max(high) - min(low)) / arg_max(close, ts) >= 1.0, false) AS wide FROM hours GROUP BY 1, 2), judged AS (SELECT *, bool_or(wide) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS wide_1 FROM dd)", f"r AS (SELECT symbol, ts, close / lag(close, 24) OVER ({HOUR}) - 1 AS ret FROM hours), q AS (SELECT symbol, ts, coalesce(ret < 0, false) AS down, bool_or(coalesce(ret > 0, false)) OVER ({HOUR} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS up_1 FROM r), h AS (SELECT q.*, j.wide, j.wide_1 FROM q ASOF JOIN judged j ON j.symbol = q.symbol AND q.ts >= j.d)"),
    "cnd_control": S.recursive(f"SELECT 'state' AS label, symbol, d FROM whole WHERE volume_zscore_30d >= 1 UNION ALL SELECT 'whole', symbol, d FROM (SELECT *, {S.roll('bool_or(coalesce(cpi_surprise >= -0.5, false))', 15)} AS recent FROM whole) WHERE recent AND volume_zscore_30d >= 1", *S.ALL),
    "cnd_jaccard_all": S.sql("SELECT x.label AS a, y.label AS b, CAST(coalesce(both_n, 0) AS BIGINT) AS both, round(coalesce(both_n, 0) / (x.n + y.n - coalesce(both_n, 0)), 6) AS jaccard FROM (SELECT label, count(*) AS n FROM hits GROUP BY 1) x JOIN (SELECT label, count(*) AS n FROM hits GROUP BY 1) y ON x.label < y.label LEFT JOIN (SELECT p.label AS a, q.label AS b, count(*) AS both_n FROM hits p JOIN hits q USING (symbol, d) WHERE p.label < q.label GROUP BY 1, 2) m ON m.a = x.label AND m.b = y.label", S.BARS, S.IND, HITS),
    "cnd_redundancy": S.recursive("SELECT label, repeats FROM walk WHERE k > 0", S.BARS, S.IND, f"hits AS ({REDUNDANT}), n AS (SELECT label, count(*) AS n FROM hits GROUP BY 1), same AS (SELECT a, b FROM (SELECT p.label AS a, q.label AS b, count(*) AS met FROM hits p JOIN hits q USING (symbol, d) WHERE p.label <> q.label GROUP BY 1, 2) JOIN n x ON x.label = a JOIN n y ON y.label = b WHERE met / (x.n + y.n - met) > 0.6), near AS (SELECT k, label, (SELECT coalesce(list(b), []) FROM same WHERE a = label) AS near FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd'), (5, 'e')) t(k, label)), walk AS (SELECT 0 AS k, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS repeats UNION ALL SELECT k, CASE WHEN clash IS NULL THEN list_append(kept, label) ELSE kept END, label, clash FROM (SELECT x.k, w.kept, x.label, list_filter(w.kept, lambda v: list_contains(x.near, v))[1] AS clash FROM walk w JOIN near x ON x.k = w.k + 1))"),
    "cnd_sweep_jaccard": S.sql("SELECT a, b, met AS both, round(met / (x.n + y.n - met), 6) AS jaccard FROM (SELECT p.label AS a, q.label AS b, count(*) AS met FROM hits p JOIN hits q USING (symbol, d) WHERE p.label < q.label GROUP BY 1, 2) JOIN n x ON x.label = a JOIN n y ON y.label = b", S.BARS, S.IND, f"grid AS (SELECT label, v, u FROM (VALUES {SWEEP}) t(label, v, u)), hits AS (SELECT label, symbol, d FROM ind JOIN grid ON volume_zscore_30d >= v AND donchian_pct_20d < u), n AS (SELECT label, count(*) AS n FROM hits GROUP BY 1)"),
    "cnd_relax_until_testable": S.recursive("SELECT t.label, CAST(min(t.x) FILTER (good) AS DOUBLE) AS step, CAST(arg_min(t.v, t.x) FILTER (good) AS DOUBLE) AS threshold FROM (SELECT *, (SELECT count(*) FROM found f WHERE f.key = label || '/' || CAST(x AS VARCHAR)) >= 120 AND (SELECT count(*) FROM walk w WHERE w.key = label || '/' || CAST(x AS VARCHAR)) >= 40 AS good FROM tried) t GROUP BY 1", S.BARS, S.IND, f"tried AS (SELECT * FROM (VALUES {RELAXED}) t(label, x, v, r)), found AS (SELECT label || '/' || CAST(x AS VARCHAR) AS key, symbol, d FROM ind JOIN tried ON volume_zscore_30d >= v AND range_zscore_30d >= r), days AS (SELECT DISTINCT key, symbol, d FROM found)", WALK.format(21)),
    "cnd_testable": S.recursive(f"SELECT label, n, episodes, reason IS NULL AS testable, reason FROM (SELECT *, CASE WHEN n < 120 THEN 'occurred ' || CAST(n AS VARCHAR) || ' times of 120 needed' WHEN episodes < 40 THEN 'occurred on only ' || CAST(episodes AS VARCHAR) || ' separate occasions of 40 needed' END AS reason FROM (SELECT label, (SELECT count(*) FROM hits h WHERE h.label = l.label) AS n, (SELECT count(*) FROM walk w WHERE w.key = l.label) AS episodes FROM (VALUES {LABELS}) l(label)))", S.BARS, S.IND, HITS, "days AS (SELECT DISTINCT label AS key, symbol, d FROM hits)", WALK.format(21)),
    "flagship_event_study": S.sql("SELECT symbol, period, count(*) AS n, round(avg(fwd_3), 6) AS mean_fwd_3, round(avg(mfe_7), 6) AS mean_mfe_7, round(avg(mae_7), 6) AS mean_mae_7 FROM ev GROUP BY 1, 2", S.REGION_BARS, S.SURPRISE, S.IND, S.EV.replace(" FROM ind) WHERE", f", {S.roll('bool_or(coalesce(sp <= -0.3, false))', 8)} AS recent FROM (SELECT ind.*, s.surprise AS sp FROM ind LEFT JOIN (SELECT published, surprise FROM surprise WHERE series = '1-URGENT') s ON ind.d = s.published)) WHERE recent AND")),
    "cnd_clause": S.sql("SELECT symbol, d, v1 AS fired FROM lit", S.BARS, S.IND, HITS),
    "cnd_within_days": S.sql("SELECT symbol, d, v3 AS fired FROM lit", S.BARS, S.IND, HITS),
    "cnd_static_triggers": S.recursive(f"SELECT symbol, d, coalesce(funding_zscore_30d < -2, false) AS c1_long, coalesce(funding_zscore_30d > 2, false) AS c1_short, wide AND close < open AS c2_long, wide AND close > open AS c2_short, strong AND coalesce(close_return_5d > 0, false) AS c6_long, strong AND coalesce(close_return_5d < 0, false) AS c6_short FROM (SELECT *, coalesce(range_pct > 1.5 * {S.roll('avg(range_pct)', 20)} AND {S.roll('count(range_pct)', 20)} >= 10, false) AND is_macro_day = 1 AS wide, coalesce(efficiency_ratio_20d > 0.4 AND volume > 1.8 * {S.roll('avg(volume)', 20)} AND {S.roll('count(volume)', 20)} >= 10, false) AS strong FROM whole)", *S.ALL),
    "cnd_occurrence_set": S.sql("SELECT label, symbol, d FROM hits", S.BARS, S.IND, HITS),
    "cnd_count": S.sql("SELECT label, count(*) AS n FROM hits GROUP BY 1", S.BARS, S.IND, HITS),
    "cnd_episode_count": S.recursive("SELECT key AS label, symbol, count(*) AS n_episodes FROM walk GROUP BY 1, 2", S.BARS, S.IND, HITS, "days AS (SELECT DISTINCT label AS key, symbol, d FROM hits)", WALK.format(21)),
    "cnd_jaccard": S.sql("SELECT a, b, round(both_n / (x.n + y.n - both_n), 6) AS jaccard FROM (SELECT p.label AS a, q.label AS b, count(*) AS both_n FROM hits p JOIN hits q USING (symbol, d) WHERE p.label < q.label GROUP BY 1, 2) JOIN (SELECT label, count(*) AS n FROM hits GROUP BY 1) x ON x.label = a JOIN (SELECT label, count(*) AS n FROM hits GROUP BY 1) y ON y.label = b", S.BARS, S.IND, HITS),
    "cnd_relax_counts": S.sql(" UNION ALL ".join(f"SELECT '{x:.2f}' AS label, count(*) AS n FROM ind WHERE volume_zscore_30d >= {round(2 - 2 * x, 4)} HAVING count(*) > 0" for x in (0.1, 0.25, 0.5)), S.BARS, S.IND),
    "cnd_grammar_enumerate": "SELECT direction, CAST(2 AS INTEGER) AS n_clauses, count(*) AS n FROM range(3) a, range(2) b, range(3) c, (SELECT unnest(['long', 'short']) AS direction) GROUP BY 1, 2",
    "cnd_spec_roundtrip": f"SELECT * FROM (VALUES {LITERAL_SPECS}) t(label, text)",
    "jn_pit_latest_revision": S.sql("SELECT series, period, value FROM vintage WHERE realtime_start <= DATE '1998-06-30' QUALIFY row_number() OVER (PARTITION BY series, period ORDER BY realtime_start DESC) = 1", S.VINTAGE),
    "jn_semi_calendar": S.sql("SELECT symbol, d, close FROM bars WHERE d IN (SELECT d FROM calendar)", S.BARS, S.CALENDAR),
    "jn_asof_next_bar": S.sql("SELECT a.symbol, a.d, b.d AS next_d, b.open AS next_open FROM bars a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.d < b.d", S.BARS),
    "jn_ffill_daily_to_hourly": S.sql("SELECT h.symbol, h.ts, g.known FROM hours h ASOF LEFT JOIN (SELECT symbol, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS t, max(close) AS known FROM hours GROUP BY 1, 2) g ON g.symbol = h.symbol AND h.ts >= g.t", S.HOURS),
    "evt_build_events": S.sql(f"SELECT symbol, trigger_d, entry_loc, entry_price, regime, {S.r(*EVENT_COLUMNS)} FROM ev", *BASE),
    "evt_regime_split": S.sql("SELECT symbol, count(*) FILTER (regime = 'normal') AS n_normal, count(*) FILTER (regime = 'shock') AS n_shock FROM ev GROUP BY 1", *BASE),
    "evt_basket": S.sql("SELECT x.d, round(avg(y.close / x.close - 1), 6) AS basket FROM p x JOIN p y ON y.symbol = x.symbol AND y.k = x.k + 7 GROUP BY 1", S.BARS, "p AS (SELECT symbol, d, close, dense_rank() OVER (ORDER BY d) AS k FROM bars)"),
    "evt_market_adjust": S.sql("SELECT symbol, trigger_d, round(fwd_7 - coalesce(basket, 0), 6) AS adjusted FROM ev LEFT JOIN basket ON d = trigger_d", *BASE, "p AS (SELECT symbol, d, close, dense_rank() OVER (ORDER BY d) AS k FROM bars), basket AS (SELECT x.d, avg(y.close / x.close - 1) AS basket FROM p x JOIN p y ON y.symbol = x.symbol AND y.k = x.k + 7 GROUP BY 1)"),
    "evt_anchors": S.sql("SELECT CAST(h AS INTEGER) AS h, round(f, 6) AS mfe_anchor, round(a, 6) AS mae_anchor FROM anchor", *BASE, S.LONG, ANCHOR),
    "evt_elapsed_bucket": "SELECT id, CAST((SELECT min(x) FROM (SELECT unnest([1, 3, 7, 14, 21]) AS x) WHERE x >= id) AS INTEGER) AS bucket FROM range(1, 31) t(id)",
    "evt_simulate_trade": S.sql("SELECT symbol, trigger_d, outcome, round(net_return, 6) AS net_return FROM trade", *BASE, S.LONG, ANCHOR, MET, HIT),
    "evt_report": S.sql(f"SELECT symbol, n, round(win_rate, 6) AS win_rate, round(strict_win_rate, 6) AS strict_win_rate, round(sortino, 6) AS sortino, round(total_expectancy, 6) AS total_expectancy, round(timeout_fraction, 6) AS timeout_fraction FROM (SELECT symbol, {REPORT}, count(*) FILTER (outcome = 'win') / count(*) AS strict_win_rate, sum(net_return) AS total_expectancy, count(*) FILTER (outcome = 'timeout') / count(*) AS timeout_fraction FROM trade GROUP BY 1)", *BASE, S.LONG, ANCHOR, MET, HIT),
    "evt_compression_exit": S.sql(f"SELECT symbol, start_d, d AS end_d, fifth AS confirmed_d, loc - start_loc AS duration, round(z_start, 6) AS z_start, round(z, 6) AS z_end, round(close / start_close - 1, 6) AS squeeze_return, round(close / pc - 1, 6) AS end_return FROM (SELECT *, last_value(CASE WHEN on_ AND NOT coalesce(was, false) THEN loc END IGNORE NULLS) OVER u AS start_loc, last_value(CASE WHEN on_ AND NOT coalesce(was, false) THEN d END IGNORE NULLS) OVER u AS start_d, last_value(CASE WHEN on_ AND NOT coalesce(was, false) THEN close END IGNORE NULLS) OVER u AS start_close, last_value(CASE WHEN on_ AND NOT coalesce(was, false) THEN z END IGNORE NULLS) OVER u AS z_start FROM (SELECT *, lag(on_) OVER ({S.W}) AS was, {S.ahead('bool_or(on_)', 1, 5)} AS again, lead(d, 5) OVER ({S.W}) AS fifth, lag(close) OVER ({S.W}) AS pc FROM (SELECT *, vol_compression_zscore AS z, coalesce(vol_compression_zscore >= 1.0, false) AS on_ FROM ind)) WINDOW u AS ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE NOT on_ AND was AND NOT again AND fifth IS NOT NULL", S.BARS, S.IND),
    "wf_folds": S.sql("SELECT CAST(fold AS INTEGER) AS fold, CAST(n_train AS BIGINT) AS n_train, n_test FROM folds", *BASE, S.FOLDS),
    "wf_barrier_grid": S.sql(f"SELECT CAST(fold AS INTEGER) AS fold, tp, sl, n, round(sortino, 6) AS sortino, round(win_rate, 6) AS win_rate FROM (SELECT fold, tp, sl, {REPORT} FROM traded GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(sortino, 9) DESC NULLS LAST, tp, sl) = 1", *BASE, S.LONG, S.FOLDS, MET, GRID),
    "wf_horizon_select": S.sql("SELECT CAST(fold AS INTEGER) AS fold, CAST(h AS INTEGER) AS h, round(score, 6) AS score FROM best", *BASE, S.LONG, S.FOLDS, S.FORWARD, SPAN.format("<"), SCORE),
    "wf_oos_returns": S.sql("SELECT symbol, trigger_d, CAST(period AS INTEGER) AS period, CAST(h AS INTEGER) AS h, round(fwd, 6) AS fwd FROM long_ev JOIN best USING (h) WHERE fold = period", *BASE, S.LONG, S.FOLDS, S.FORWARD, SPAN.format("<"), SCORE),
    "wf_baseline_incremental": S.sql("SELECT CAST(period AS INTEGER) AS period, count(*) AS n, round(avg(fwd_3), 6) AS mean FROM ev WHERE NOT EXISTS (SELECT 1 FROM ind i WHERE i.symbol = ev.symbol AND i.loc + 1 = ev.entry_loc AND coalesce(i.range_zscore_30d >= 0.5, false)) GROUP BY 1", *BASE),
    "wf_baseline_unconditional": S.sql("SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(avg(base), 6) AS mean FROM around WHERE h = 3 GROUP BY 1", *BASE, S.FOLDS, S.FORWARD, SPAN.format("=")),
    "wf_bootstrap_lcg": S.sql("SELECT symbol, count(*) AS reps, round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS most FROM (SELECT symbol, b, avg(base) AS m FROM (SELECT symbol, b, ((b * 7919 + j * 104729 + 12345) * 48271 % 2147483647) % (n - 8) + i AS k FROM (SELECT symbol, count(*) AS n FROM pool GROUP BY 1), range(200) x(b), range(10) y(j), range(9) w(i)) JOIN pool USING (symbol, k) GROUP BY 1, 2) GROUP BY 1", S.BARS, S.IND, S.FORWARD, "pool AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY loc) - 1 AS k, base FROM forward_of WHERE h = 3 AND base IS NOT NULL)"),
    "wf_concentration": S.sql("SELECT CAST(y.period AS INTEGER) AS period, round(max_share, 6) AS max_share, dominant, max_share > 0.6 AS concentrated FROM (SELECT DISTINCT period FROM ev) y LEFT JOIN (SELECT period, max(s) / sum(s) AS max_share, arg_max(symbol, (s, symbol)) AS dominant FROM (SELECT period, symbol, sum(fwd_7) AS s FROM ev GROUP BY 1, 2) WHERE s > 0 GROUP BY 1) z ON z.period = y.period", *BASE),
    "wf_classify": S.sql("SELECT candidate, status FROM verdict", S.BATTERY, VERDICT),
    "wf_explain": S.sql(f"SELECT candidate, {REASONS} AS reason FROM battery", S.BATTERY),
    "wf_bh": S.sql("SELECT candidate, coalesce(p <= (SELECT cut FROM cut), false) AS survives FROM battery", S.BATTERY, FAMILY.format("")),
    "wf_bh_weighted": S.sql("SELECT b.candidate, coalesce(q <= cut, false) AS survives FROM battery b LEFT JOIN w USING (candidate) LEFT JOIN cut ON cut.brand = b.brand", S.BATTERY, "w AS (SELECT candidate, brand AS fam, p / (weight / avg(weight) OVER (PARTITION BY brand)) AS q FROM battery WHERE p IS NOT NULL), fam AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY q) AS rk, count(*) OVER (PARTITION BY fam) AS m FROM w), cut AS (SELECT fam AS brand, max(q) AS cut FROM fam WHERE q <= 0.05 * rk / m GROUP BY 1)"),
    "wf_fdr_demotion": S.sql("SELECT CASE WHEN dem THEN 'rejected' ELSE status END AS status, dem AS fdr_demoted, count(*) AS n FROM (SELECT status, p IS NOT NULL AND n > 20 AND status = 'accepted' AND NOT coalesce(p <= (SELECT cut FROM cut), false) AS dem FROM verdict) GROUP BY 1, 2", S.BATTERY, VERDICT, FAMILY.format("AND n > 20")),
    "wf_required_n": S.sql("SELECT candidate, round(CASE WHEN ratio > 0 THEN 6.0 * pow((1.645 + 0.84) * (ratio / 10) / 0.05, 2) END, 4) AS n FROM battery", S.BATTERY),
    "wf_prune_codes": S.sql("SELECT candidate, CAST(year(first_tracked) AS VARCHAR) || '-' || lpad(CAST(row_number() OVER (PARTITION BY year(first_tracked) ORDER BY first_tracked, candidate) AS VARCHAR), 4, '0') AS code FROM battery", S.BATTERY),
    "stat_mann_whitney_small": f"""WITH RECURSIVE x AS (SELECT o_custkey, o_totalprice AS v, o_orderstatus = 'F' AS t, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0 AS rk FROM orders),
tied AS (SELECT o_custkey, sum(pow(k, 3) - k) AS ties FROM (SELECT o_custkey, v, CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY 1, 2) GROUP BY 1),
sums AS (SELECT o_custkey, count(*) FILTER (t) AS n1, count(*) FILTER (NOT t) AS n2, sum(rk) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0 AS u FROM x GROUP BY 1),
told AS (SELECT *, least(n1, n2) AS a, greatest(n1, n2) AS b, least(n1, n2) <= 8 AND ties = 0 AS few, (u - n1 * n2 / 2.0 - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1.0), 0))), 0) AS z FROM sums JOIN tied USING (o_custkey)),
dist AS (SELECT a, b, CAST(0 AS BIGINT) AS i, list_transform(range(0, a * b + 1), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM (SELECT DISTINCT a, b FROM told WHERE few AND a > 0)
 UNION ALL SELECT a, b, i + 1, list_transform(range(1, a * b + 2), lambda k: list_sum(list_transform(range(0, (k - 1) // (i + 1) + 1), lambda j: t[k - (i + 1) * j]))) FROM (SELECT *, list_transform(range(1, a * b + 2), lambda k: c[k] - CASE WHEN k > b + i + 1 THEN c[k - b - i - 1] ELSE 0 END) AS t FROM dist WHERE i < a)),
tail AS (SELECT a, b, c FROM dist WHERE i = a)
SELECT o_custkey, n1, n2, round(u, 2) AS u, round(CASE WHEN a = 0 THEN NULL WHEN few THEN list_sum(c[CAST(u AS BIGINT) + 1 :]) / list_sum(c) ELSE {tail_sql('z')} END, 6) AS p FROM told LEFT JOIN tail USING (a, b)""",
    "stat_mann_whitney": S.sql(f"SELECT symbol, n1, n2, u, round(z, 6) AS z, round({tail_sql('z')}, 6) AS p FROM (SELECT symbol, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u, (u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM (SELECT symbol, n1, n2, ties, r - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT symbol, sum(rk) FILTER (t) AS r, CAST(count(*) FILTER (t) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT t) AS DOUBLE) AS n2 FROM x GROUP BY 1) JOIN (SELECT symbol, sum(pow(k, 3) - k) AS ties FROM (SELECT symbol, ret, CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY 1, 2) GROUP BY 1) USING (symbol)))", S.BARS, S.IND, "x AS (SELECT symbol, ret, dayofweek(d) = 1 AS t, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0 AS rk FROM base WHERE ret IS NOT NULL)"),
    "stat_signed_rank": S.sql(f"SELECT symbol, n, round(wp, 2) AS w_plus, round(wm, 2) AS w_minus, round(z, 6) AS z, round(least(1.0, 2 * {tail_sql('abs(z)')}), 6) AS p FROM (SELECT *, (wp - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM (SELECT symbol, count(*) AS n, coalesce(sum(rk) FILTER (x > 0), 0) AS wp, coalesce(sum(rk) FILTER (x < 0), 0) AS wm FROM ranked GROUP BY 1) JOIN (SELECT symbol, sum(pow(k, 3) - k) AS ties FROM (SELECT symbol, abs(x) AS a, CAST(count(*) AS DOUBLE) AS k FROM ranked GROUP BY 1, 2) GROUP BY 1) USING (symbol))", *BASE, "ranked AS (SELECT symbol, x, rank() OVER (PARTITION BY symbol ORDER BY abs(x)) + (count(*) OVER (PARTITION BY symbol, abs(x)) - 1) / 2.0 AS rk FROM (SELECT symbol, round(fwd_7 - fwd_3, 4) AS x FROM ev) WHERE x <> 0)"),
    "stat_fisher_exact": "SELECT id, round(sum(exp(lgamma(id + 6) - lgamma(k + 1) - lgamma(id + 6 - k) + lgamma(id + 8) - lgamma(id + 4 - k) - lgamma(4 + k + 1) + lgamma(id + 4) + lgamma(id + 9 + 1) - lgamma(id + id + 13))), 6) AS p FROM (SELECT id, unnest(range(id, least(id + 5, id + 3) + 1)) AS k FROM range(1, 9) t(id)) GROUP BY 1",
}

QUERIES |= {
    "evt_path_outcome": lambda s, d: (lambda df: df.select("symbol", "d", *E.path_outcome(df, 7)).select("symbol", "d", *rounded("outcome", "mfe", "mae")))(panels.bars_1d(s, d)),
    "evt_prospective_split": lambda s, d: E.prospective_split(panel(s, d), VOLUME.column(), F.lit("1998-06-30").cast("date"), 7, "symbol").select("symbol", "n_before", "n_after", *rounded("mean_after", "baseline")),
    "wf_prune_reco": lambda s, d: battery(s, d).select("candidate", walkforward.keep_or_drop(F.col("n"), F.col("status"), F.col("p") < 0.1, F.col("ratio") / 20).alias("advice")),
    "agg_status_groups": lambda s, d: battery(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list("candidate")), 1, 8).cast("array<string>"), ",").alias("first_names")),
}
ORACLE |= {
    "evt_path_outcome": S.sql(f"SELECT symbol, d, round(CASE WHEN last IS NOT NULL THEN last / price - 1 END, 6) AS outcome, round(CASE WHEN last IS NOT NULL THEN high_7 / price - 1 END, 6) AS mfe, round(CASE WHEN last IS NOT NULL THEN abs(low_7 / price - 1) END, 6) AS mae FROM (SELECT symbol, d, lead(open) OVER ({S.W}) AS price, lead(close, 8) OVER ({S.W}) AS last, {S.ahead('max(high)', 2, 8)} AS high_7, {S.ahead('min(low)', 2, 8)} AS low_7 FROM bars)", S.BARS),
    "evt_prospective_split": S.sql("SELECT symbol, count(*) FILTER (v1 AND d < DATE '1998-06-30') AS n_before, count(*) FILTER (v1 AND d >= DATE '1998-06-30') AS n_after, round(avg(f) FILTER (v1 AND d >= DATE '1998-06-30'), 6) AS mean_after, round(avg(f) FILTER (d >= DATE '1998-06-30'), 6) AS baseline FROM (SELECT *, lead(close, 7) OVER (PARTITION BY symbol ORDER BY d) / close - 1 AS f FROM lit) GROUP BY 1", S.BARS, S.IND, HITS),
    "wf_prune_reco": S.sql("SELECT candidate, CASE WHEN status IN ('accepted', 'insufficient_data') OR n <= 20 OR coalesce(p < 0.1, false) THEN 'keep' WHEN ratio > 0 AND n >= 6.0 * pow((1.645 + 0.84) * (ratio / 20) / 0.05, 2) THEN 'drop' ELSE 'keep' END AS advice FROM verdict", S.BATTERY, VERDICT),
    "agg_status_groups": S.sql("SELECT status, count(*) AS n, array_to_string(list_slice(list_sort(list(candidate)), 1, 8), ',') AS first_names FROM verdict GROUP BY 1", S.BATTERY, VERDICT),
}
