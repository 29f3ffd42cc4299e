"""A battery of conditions from bars to verdicts.

All candidates share one panel, one table of firings keyed by candidate, one bootstrap and one family of p-values, so neither the plan
nor the count of jobs grows with the candidates.  Folds are the years of a candidate's events; what a fold's training years
say is a running sum over years, so no event is repeated for each later fold but for its own barrier trades.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import slices
from tessera.functions.series import ahead, by_day
from tessera.operators import events as E
from tessera.operators import indicators as I  # noqa: E741
from tessera.operators import walkforward as W
from tessera.plans.grammar import Clause, Spec
from tessera.sources.state import cut


@dataclass(frozen=True)
class Sides:
    """Side tables of a panel; what is missing gives null indicators."""

    funding: DataFrame | None = None
    days: DataFrame | None = None
    surprises: DataFrame | None = None
    series: dict[str, str] | None = None

    def until(self, day: date) -> Sides:
        """What was known on the day."""
        known = lambda df, c: None if df is None else df.where(F.col(c) <= F.lit(day))
        return Sides(known(self.funding, "d"), known(self.days, "d"), known(self.surprises, "published"), self.series)


def measured(panel: DataFrame, horizons: list[int], relative: bool, rows: int = slices.ROWS) -> DataFrame:
    """The panel with what a trade that a row triggers would meet: price, and for each horizon the greatest and least price,
    the change of the close from each row (`base`) and, if asked for, that change less the basket's (`apart`)."""

    def ahead_of(df: DataFrame) -> DataFrame:
        columns = {"price": F.lead("open", 1).over(by_day()), "regime": E.regime(), "period": F.year("d")}
        for h in horizons:
            columns |= {f"top_{h}": F.max("high").over(ahead(2, 1 + h)), f"bottom_{h}": F.min("low").over(ahead(2, 1 + h)), f"base_{h}": F.try_divide(F.lead("close", h).over(by_day()), F.col("close")) - 1}
        df = df.withColumns(columns)
        for h in horizons:
            if relative:
                df = df.join(E.basket(panel, h).withColumnRenamed("basket", f"basket_{h}"), "d", "left")
            df = df.withColumn(f"apart_{h}", E.market_adjusted(F.col(f"base_{h}"), F.col(f"basket_{h}")) if relative else F.col(f"base_{h}"))
        return df.withColumns({f"{k}_from_{h}": F.lead(f"{k}_{h}", 1).over(by_day()) for h in horizons for k in ("base", "apart")})

    return slices.over_slices(panel, ahead_of, 0, max(horizons) + 2, rows)


def paths(panel: DataFrame, fired: DataFrame, most: int, rows: int = slices.ROWS) -> DataFrame:
    """symbol, entry_loc, path of each row of the panel that fires for any candidate, once."""
    bars = panel.select("symbol", "d", "loc", "n_rows", "high", "low")
    met = slices.over_slices(bars, lambda df: df.withColumn("path", E.path_frame(most)), 0, most + 2, rows).select("symbol", (F.col("loc") + 1).alias("entry_loc"), "path")
    return met.join(fired.select("symbol", "entry_loc").distinct(), ["symbol", "entry_loc"], "left_semi")


def candidates(spark, specs: list[Spec], days: list[date] | None = None) -> DataFrame:
    """A row a specification, or one for each of the days as of which it is judged, with what the later steps need of it."""
    rows = [
        (a * len(specs) + k, day, s.label, 1 if s.direction == "long" else -1, sorted(s.horizons), max(s.horizons), s.uses("shock_zscore"), s.outcome == "market_relative", float(s.prior_weight), s.coins is not None and len(s.coins) == 1, control(s) is not None)
        for a, day in enumerate(days or [None])
        for k, s in enumerate(specs)
    ]
    return spark.createDataFrame(rows, "k int, as_of date, candidate string, sign int, horizons array<int>, most int, shocks boolean, relative boolean, weight double, one_symbol boolean, contrast boolean")


def control(spec: Spec) -> Spec | None:
    """The state clauses alone, where they say less than the whole."""
    rest = spec.without_events()
    return rest if rest is not None and len(rest.clauses) < len(spec.clauses) else None


def seen(panel: DataFrame, days: list[date]) -> DataFrame:
    """symbol, a, n_rows: how many rows of each symbol are known on each day, a being its place."""
    known = F.array(*[F.count_if(F.col("d") <= F.lit(day)) for day in days])
    return panel.groupBy("symbol").agg(known.alias("n")).select("symbol", F.posexplode("n").alias("a", "n_rows"))


def firings(df: DataFrame, specs: list[Spec], of: DataFrame, horizons: list[int], days: list[date] | None = None, rows: int = slices.ROWS) -> DataFrame:
    """A row for each candidate and row of the panel that fires, treated or as its control; n_rows is what is known of its symbol.

    Bars in a shock are marked as excluded, unless the specification asks for shocks; those whose longest horizon is not complete are none.  With days, a
    firing gives a row for each day on which its horizon is complete: what fires looks back only, so only that depends on the day.
    """
    controls = {k: c for k, s in enumerate(specs) if (c := control(s)) is not None}

    def flagged(df: DataFrame) -> DataFrame:
        return df.withColumns({f"__t{k}": s.column() for k, s in enumerate(specs)} | {f"__c{k}": c.column() for k, c in controls.items()})

    reach = max(c.within_days for s in specs for c in s.clauses)
    df = slices.over_slices(df, flagged, reach, 0, rows) if reach else flagged(df)
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__t{k}").alias("treated"), (F.col(f"__c{k}") if k in controls else F.lit(False)).alias("state")) for k in range(len(specs))])
    out = lambda h: F.struct(F.lit(h).alias("h"), F.col(f"top_{h}").alias("top"), F.col(f"bottom_{h}").alias("bottom"), F.col(f"base_from_{h}").alias("base"), F.col(f"apart_from_{h}").alias("apart"))
    fired = df.select("symbol", "d", "loc", "n_rows", "price", "regime", "period", F.array(*map(out, horizons)).alias("outs"), F.explode(F.filter(each, lambda x: x["treated"] | x["state"])).alias("x"))
    met = fired.select("*", "x.*").drop("x")
    if days:
        met = met.drop("n_rows").join(seen(df, days), "symbol").withColumn("k", (F.col("a") * len(specs) + F.col("k")).cast("int"))
    met = met.join(of, "k").where((F.col("loc") + 1 + F.col("most") < F.col("n_rows")) & (F.col("price") > 0))
    met = met.withColumn("excluded", (F.col("regime") != "normal") & ~F.col("shocks"))
    sign, price = F.col("sign"), F.col("price")
    best = lambda x, good: F.when((sign > 0) == F.lit(good), x["top"]).otherwise(x["bottom"])
    moved = lambda x, good: sign * (F.try_divide(best(x, good), price) - 1)
    value = lambda x: sign * F.when(F.col("relative"), x["apart"]).otherwise(x["base"])
    told = F.transform(F.filter("outs", lambda x: F.array_contains("horizons", x["h"])), lambda x: F.struct(x["h"].alias("h"), moved(x, True).alias("mfe"), moved(x, False).alias("mae"), value(x).alias("value")))
    return met.select("k", "treated", "state", "excluded", "symbol", F.col("d").alias("trigger_d"), (F.col("loc") + 1).alias("entry_loc"), "n_rows", "period", F.col("price").alias("entry_price"), "sign", told.alias("outs"))


def trained(long: DataFrame, folds: DataFrame) -> DataFrame:
    """k, fold, h and of the training years the events, mean and deviation of their values, and mean excursions."""
    year = long.groupBy("k", "period", "h").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.sum("mfe").alias("f"), F.sum(F.abs("mae")).alias("a"))
    before = Window.partitionBy("k", "h").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    upto = year.select("k", "period", "h", *[F.sum(c).over(before).alias(c) for c in ("n", "s", "q", "f", "a")])
    rows = upto.join(folds.select("k", F.col("fold").alias("period")), ["k", "period"])
    n = F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)))
    return rows.select("k", F.col("period").alias("fold"), "h", "n", (F.col("s") / n).alias("mean"), F.when(n > 1, spread).alias("sd"), (F.col("f") / n).alias("mfe_anchor"), (F.col("a") / n).alias("mae_anchor"))


def running(df: DataFrame, horizons: list[int], rows: int = slices.ROWS) -> DataFrame:
    """symbol, loc, h, and up to each row the count and sum of the usable changes, raw and apart from the basket."""
    sums = {}
    for h in horizons:
        usable = F.col(f"base_{h}").isNotNull()
        sums |= {f"c_{h}": usable.cast("long"), f"s_{h}": F.when(usable, F.col(f"base_{h}")), f"a_{h}": F.when(usable, F.col(f"apart_{h}"))}
    known = slices.summed(df.select("symbol", "loc", *[f"{k}_{h}" for h in horizons for k in ("base", "apart")]), sums, rows)
    each = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"c_{h}").alias("c"), F.col(f"s_{h}").cast("double").alias("base"), F.col(f"a_{h}").cast("double").alias("apart")) for h in horizons])
    return known.select("symbol", "loc", F.explode(each).alias("x")).select("symbol", "x.h", "loc", "x.c", "x.base", "x.apart")


def trained_baseline(spans: DataFrame, folds: DataFrame, of: DataFrame, sums: DataFrame) -> DataFrame:
    """k, fold, h, b: the mean change of the bars between the first and the last training entry of each symbol.

    spans: k, symbol, period, lo, hi.  A range's sum is a difference of two running sums, met by equi-joins.
    """
    before = spans.join(folds.select("k", "fold"), "k").where(F.col("period") < F.col("fold")).groupBy("k", "fold", "symbol").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = before.join(of.select("k", "sign", "relative", F.explode("horizons").alias("h")), "k")
    at = lambda name, loc: sums.select("symbol", "h", F.col("loc").alias(loc), F.col("c").alias(f"c_{name}"), F.col("base").alias(f"base_{name}"), F.col("apart").alias(f"apart_{name}"))
    met = rows.withColumn("below", F.col("lo") - 1).join(at("hi", "hi"), ["symbol", "h", "hi"]).join(at("lo", "below"), ["symbol", "h", "below"], "left").fillna(0.0, ["c_lo", "base_lo", "apart_lo"])
    total = F.col("sign") * F.when(F.col("relative"), F.col("apart_hi") - F.col("apart_lo")).otherwise(F.col("base_hi") - F.col("base_lo"))
    return met.groupBy("k", "fold", "h").agg(F.try_divide(F.sum(total), F.sum(F.col("c_hi") - F.col("c_lo"))).alias("b"))


def chosen_horizon(train: DataFrame, base: DataFrame) -> DataFrame:
    """k, fold, h: the greatest (mean - baseline) over deviation in the training years; the least h of equals, and where none has a score."""
    score = F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("mean") - F.col("b")) / F.col("sd"))
    best = Window.partitionBy("k", "fold").orderBy(F.round("score", 12).desc_nulls_last(), "h")
    return train.join(base, ["k", "fold", "h"], "left").withColumn("score", score).withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).select("k", "fold", "h", "score")


def unconditional_pool(spans: DataFrame, chosen: DataFrame, of: DataFrame, df: DataFrame, horizons: list[int]) -> DataFrame:
    """k, chunk, base: the changes of all bars between the first and last entry of a fold's test events, a chunk a fold and symbol."""
    rows = df.select("symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col("loc").alias("loc"), F.col(f"base_{h}").alias("base"), F.col(f"apart_{h}").alias("apart")) for h in horizons])).alias("x")).select("symbol", "x.*")
    history = rows.groupBy("symbol", "h").agg(F.array_sort(F.collect_list(F.struct("loc", "base", "apart"))).alias("rows"))
    test = spans.withColumnRenamed("period", "fold").join(chosen.select("k", "fold", "h"), ["k", "fold"]).join(of.where(~F.col("contrast")).select("k", "sign", "relative"), "k").join(history, ["symbol", "h"])
    part = F.filter(F.slice("rows", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int")), lambda x: x["base"].isNotNull())
    base = F.transform(part, lambda x: F.col("sign") * F.when(F.col("relative"), x["apart"]).otherwise(x["base"]))
    return test.select("k", F.concat_ws("/", "fold", "symbol").alias("chunk"), base.alias("base")).where(F.size("base") > 0)


def incremental_pool(fired: DataFrame, chosen: DataFrame, of: DataFrame) -> DataFrame:
    """k, chunk, base: the values of the control's events that are not treated, a chunk a fold."""
    rows = fired.where(F.col("state") & ~F.col("treated")).join(of.where("contrast").select("k"), "k", "left_semi").withColumnRenamed("period", "fold")
    met = rows.select("k", "fold", "symbol", "entry_loc", F.explode("outs").alias("x")).select("k", "fold", "symbol", "entry_loc", "x.h", "x.value").join(chosen.select("k", "fold", "h"), ["k", "fold", "h"]).where("value IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("symbol", "entry_loc", "value"))), lambda x: x["value"])
    return met.groupBy("k", "fold").agg(ordered.alias("base")).select("k", F.col("fold").cast("string").alias("chunk"), "base")


def barrier_trades(treated: DataFrame, path_of: DataFrame, train: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample trades (k, symbol, period, trigger_d, outcome, net_return) and the settings behind them (k, fold, tp, sl, n, sortino).

    Anchors come from the training years; each fold takes the setting that served them best, and trades its own year with it.
    """
    anchors = F.array_sort(F.collect_list(F.struct("h", F.col("mfe_anchor").alias("mfe"), F.col("mae_anchor").alias("mae"))))
    levels = cut(train.groupBy("k", "fold").agg(anchors.alias("levels")).join(folds.select("k", "fold"), ["k", "fold"]))
    known = F.slice("path", F.lit(1), F.greatest(F.lit(0), F.col("n_rows") - F.col("entry_loc") - 1).cast("int"))
    met = treated.select("k", "symbol", "period", "trigger_d", "entry_loc", "n_rows", "entry_price", "sign").join(path_of, ["symbol", "entry_loc"]).withColumn("path", known)
    spread = int(treated.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: Spark would put them into few tasks
    results = E.grid_results(met.repartition(spread, "k", "symbol", "entry_loc"), levels, ["k"], ["symbol", "entry_loc"])
    settings = cut(E.best_setting(results, ["k", "fold"]).select("k", "fold", "tp", "sl", "n", "sortino"))
    chosen = levels.join(settings.select("k", "fold", "tp", "sl"), ["k", "fold"]).withColumnRenamed("fold", "period")
    own = met.join(chosen, ["k", "period"]).withColumn("r", E.trade(F.col("path"), F.col("entry_price"), F.col("sign"), F.col("levels"), F.col("tp"), F.col("sl")))
    return own.select("k", "symbol", "period", "trigger_d", F.col("r.outcome").alias("outcome"), F.col("r.net").alias("net_return")), settings


@dataclass(frozen=True)
class Evidence:
    """The tables between bars and verdicts, each keyed by candidate (k)."""

    of: DataFrame
    fired: DataFrame
    folds: DataFrame
    train: DataFrame
    chosen: DataFrame
    outcomes: DataFrame
    pool: DataFrame
    counts: DataFrame
    anchors: DataFrame
    trades: DataFrame
    settings: DataFrame


def evidence(panel: DataFrame, specs: list[Spec], days: list[date] | None = None) -> Evidence:
    """panel: `indicators.complete` of the bars.  days: each specification is a candidate of its own as of each of them."""
    horizons = sorted({h for s in specs for h in s.horizons})
    df = cut(measured(panel, horizons, any(s.outcome == "market_relative" for s in specs)))
    of = candidates(panel.sparkSession, specs, days)
    every = cut(firings(df, specs, of, horizons, days))
    counts = every.where("treated").groupBy("k").agg(F.count_if(~F.col("excluded")).alias("n_raw_triggers"), F.count_if("excluded").alias("n_shock_excluded"))
    fired = every.where(~F.col("excluded")).drop("excluded")
    treated = fired.where("treated")
    long = treated.select("k", "symbol", "period", "trigger_d", "entry_loc", F.explode("outs").alias("x")).select("k", "symbol", "period", "trigger_d", "entry_loc", "x.*")
    anchors = long.groupBy("k", "h").agg(F.avg("mfe").alias("mfe"), F.avg(F.abs("mae")).alias("mae"))
    folds = cut(W.folds(treated, "k"))
    train = cut(trained(long, folds))
    spans = treated.groupBy("k", "symbol", "period").agg(F.min("entry_loc").alias("lo"), F.max("entry_loc").alias("hi"))
    chosen = cut(chosen_horizon(train, trained_baseline(spans, folds, of, running(df, horizons))))
    outcomes = long.withColumnRenamed("period", "fold").join(chosen.select("k", "fold", "h"), ["k", "fold", "h"]).withColumnRenamed("fold", "period").where("value IS NOT NULL")
    pool = unconditional_pool(spans, chosen, of, df, horizons).unionByName(incremental_pool(fired, chosen, of))
    path_of = cut(paths(df, treated, max(horizons)))
    return Evidence(of, fired, folds, train, chosen, cut(outcomes), pool, counts, anchors, *barrier_trades(treated, path_of, train, folds))


def verdicts(e: Evidence, reps: int = 2000, dated: bool = False) -> DataFrame:
    """A row a candidate: the barrier trades' report, the pattern's test against its baseline, the verdict and the family's correction.

    dated: the candidates are those of several days, and those of one day are a family.  n_raw_triggers and n_shock_excluded count firings whose
    horizons are complete, in and out of ordinary times.  Accepted candidates also get what a live signal needs: live_anchors (of each horizon the
    mean excursions of all events) and the multiples that the last fold chose.
    """
    block = e.chosen.groupBy("k").agg(F.max_by("h", "fold").alias("horizon"), F.array_sort(F.collect_set("h")).alias("horizons_used"))
    tested = W.bootstrap_p(e.outcomes.join(block, "k").select(F.col("k").alias("candidate"), "value", (F.col("horizon") * W.BLOCK_HORIZONS).alias("block")), e.pool.withColumnRenamed("k", "candidate"), reps).withColumn("k", F.col("candidate").cast("int")).drop("candidate")
    tested = tested.withColumnRenamed("n", "n_outcomes")
    ratios = e.outcomes.groupBy("k", "period").agg(F.try_divide(F.avg("mfe"), F.avg(F.abs("mae"))).alias("r")).groupBy("k").agg(F.avg("r").alias("ratio"))
    spread = e.outcomes.groupBy("k").agg(F.stddev_samp("value").alias("oos_sd"), E.sortino(F.col("value")).alias("path_sortino"))
    reported = E.report(e.trades, "k")
    share = lambda df, group, value, name: W.concentration(df, ["k"], group, value).select("k", F.col("max_share").alias(f"{name}_share"), F.col("dominant").cast("string").alias(f"{name}_dominant"), F.col("concentrated").alias(name))
    live = e.anchors.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", F.struct("mfe", "mae"))))).alias("live_anchors"))
    last = e.settings.groupBy("k").agg(F.max_by("tp", "fold").alias("live_tp"), F.max_by("sl", "fold").alias("live_sl"))
    parts = [reported, tested, ratios, spread, block, e.counts, live, last]
    for group, name in (("symbol", "by_symbol"), ("period", "by_year")):
        parts += [share(e.outcomes, group, "value", name), share(e.trades, group, "net_return", f"{name}_traded")]
    rows = reduce(lambda a, b: a.join(b, "k", "left"), parts, e.of)
    ok = F.col("p").isNotNull()
    judged = lambda name: F.when(ok, F.col(name)).otherwise(F.col(f"{name}_traded"))  # the trades' where the pattern could not be tested
    rows = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "ok": ok, "excess": F.col("mean") - F.col("baseline_mean"), "by_symbol": F.when(F.col("one_symbol"), F.lit(False)).otherwise(judged("by_symbol")), "by_year": judged("by_year"), "baseline_kind": F.when(F.col("contrast"), "incremental").otherwise("unconditional")})
    gates = [F.col(c) for c in ("n", "sortino", "ok", "by_symbol", "by_year", "significant", "excess", "ratio")]
    advice = [F.col(c) for c in ("n", "status", "significant", "oos_sd")]
    rows = rows.withColumns({"status": W.classify(*gates), "reason": W.explain(*gates), "required_n": W.required_n(F.col("oos_sd"))})
    rows = W.demote(rows, "weight", ["as_of"] if dated else None).withColumns({"advice": W.keep_or_drop(*advice), "advice_reason": W.advice_reason(*advice, *(F.col(c) for c in ("excess", "by_symbol_share", "by_year_share", "ratio")))})
    accepted = F.col("status") == "accepted"
    rows = rows.withColumns({c: F.when(accepted, F.col(c)) for c in ("live_anchors", "live_tp", "live_sl")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_raw_triggers", "n_shock_excluded")})
    return rows.drop(*([] if dated else ["as_of"]), "k", "ok", "sign", "horizons", "most", "shocks", "relative", "one_symbol", "contrast", "by_symbol_traded", "by_year_traded", "by_symbol_traded_share", "by_year_traded_share", "by_symbol_traded_dominant", "by_year_traded_dominant")


def run(bars: DataFrame, specs: list[Spec], as_of: date | list[date] | None = None, reps: int = 2000, sides: Sides | None = None, with_static: bool = False) -> DataFrame:
    """A row a specification, and with `with_static` one for each of the six static conditions.

    Nothing after as_of is seen.  With several days it is a row for each of them too (column as_of), what a run for that day alone gives: the panel
    and its firings are made once.  A specification without a fold has n = 0 and is insufficient.  One on an indicator that the registry
    lacks gets the status `error` and keeps no other from its verdict; two of one label are refused before anything runs.
    """
    if len({s.label for s in specs}) < len(specs):
        raise ValueError("two specifications of one label")
    days = sorted(set(as_of)) if isinstance(as_of, list) else None
    last = max(days) if days else None if isinstance(as_of, list) else as_of
    lacks = {s.label: sorted({c.indicator for c in s.clauses} - I.INDICATORS.keys()) for s in specs}
    specs = [s for s in specs if not lacks[s.label]]
    sides = sides or Sides()
    if last is not None:
        bars, sides = bars.where(F.col("d") <= F.lit(last)), sides.until(last)
    panel = I.complete(bars, sides.funding, sides.days, sides.surprises, sides.series, static=with_static)
    specs = [*static_specs(), *specs] if with_static else specs
    failed = [(label, f"unknown indicators {', '.join(names)}") for label, names in lacks.items() if names]
    errors = bars.sparkSession.createDataFrame(failed, "candidate string, reason string").withColumn("status", F.lit("error"))
    if days:
        errors = errors.withColumn("as_of", F.explode(F.array(*map(F.lit, days))))
    return verdicts(evidence(panel, specs, days), reps, bool(days)).unionByName(errors, allowMissingColumns=True) if specs else errors


def live_state(battery: DataFrame) -> DataFrame:
    """candidate, h, mfe, mae, tp, sl: what the accepted candidates of a battery trade by; those that the family's correction demoted are not among them."""
    rows = battery.where("status = 'accepted' AND live_tp IS NOT NULL")
    return rows.select("candidate", F.explode("live_anchors").alias("h", "x"), "live_tp", "live_sl").select("candidate", "h", "x.mfe", "x.mae", F.col("live_tp").alias("tp"), F.col("live_sl").alias("sl"))


def static_specs() -> list[Spec]:
    """The static conditions as specifications over their columns in a complete panel."""
    return [Spec(name, (Clause(name, ">=", 1.0),), direction) for name, direction in I.STATIC.items()]


def shutdown(battery: DataFrame, dropped: DataFrame) -> bool:
    """Whether no candidate is left to test."""
    return battery.join(dropped.select("candidate"), "candidate", "left_anti").isEmpty()
