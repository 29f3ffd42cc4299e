"""Walk-forward evaluation by year, baselines, bootstrap, and the verdict rules."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.series import by_day, usable

MIN_TRAIN, MIN_REPORT, MIN_PERIODS = 20, 20, 3
SIGNIFICANCE, FDR, MAX_SHARE, BLOCK_HORIZONS, MIN_POOL = 0.10, 0.05, 0.6, 3, 20


def folds(events: DataFrame, *by: str) -> DataFrame:
    """by, fold (a year after the first three), n_train, n_test; years are few, so they meet in one window."""
    years = events.groupBy(*by, "period").agg(F.count(F.lit(1)).alias("n_test"))
    w = Window.partitionBy(*by).orderBy("period")
    years = years.withColumns({"__place": F.row_number().over(w), "n_train": F.coalesce(F.sum("n_test").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return years.where((F.col("__place") > MIN_PERIODS) & (F.col("n_train") >= MIN_TRAIN)).select(*by, F.col("period").alias("fold"), "n_train", "n_test")


def forward_by_loc(df: DataFrame, horizons) -> DataFrame:
    """symbol, loc, h, base: the change from each bar's close to the close h bars ahead."""
    df = df.select("symbol", "loc", *[(F.try_divide(F.lead("close", h).over(by_day()), F.col("close")) - 1).alias(f"f_{h}") for h in horizons])
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f_{h}").alias("base")) for h in horizons])
    return df.select("symbol", "loc", F.explode(rows).alias("x")).select("symbol", "loc", "x.h", "x.base").where("base IS NOT NULL")


def before_fold(yearly: DataFrame, of: DataFrame, by: list[str], upto: dict[str, Column]) -> DataFrame:
    """by, fold and what `upto` says of all earlier years (running aggregates in order of period).  yearly: by, period and its figures; of: fold."""
    earlier = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    every = yearly.select(*by).distinct().join(of.select(F.col("fold").alias("period")), F.lit(True)).join(yearly, [*by, "period"], "left")
    known = yearly.join(every.select(*by, "period"), [*by, "period"], "left_anti").unionByName(every, allowMissingColumns=True)
    rows = known.select(*by, "period", *[c.over(earlier).alias(n) for n, c in upto.items()])
    return rows.join(of.select(F.col("fold").alias("period")), "period").withColumnRenamed("period", "fold")


def spans(events: DataFrame, of: DataFrame, test: bool) -> DataFrame:
    """fold, symbol and the range of rows from the first to the last entry of its train or test events."""
    yearly = events.groupBy("symbol", "period").agg(F.min("entry_loc").alias("lo"), F.max("entry_loc").alias("hi"))
    if test:
        return yearly.join(of.select(F.col("fold").alias("period")), "period").select(F.col("period").alias("fold"), "symbol", "lo", "hi")
    return before_fold(yearly, of, ["symbol"], {"lo": F.min("lo"), "hi": F.max("hi")}).where("lo IS NOT NULL").select("fold", "symbol", "lo", "hi")


def baseline(forward: DataFrame, ranges: DataFrame) -> DataFrame:
    """fold, h, base_n, base_sum: the changes of the rows inside each fold's ranges, as differences of sums up to their ends.

    forward: symbol, loc, h, base; ranges: fold, symbol, lo, hi, of rows that may be missing in forward.
    """
    sums = forward.select("symbol", "h", "loc", F.col("base").alias("v"), F.lit(None).cast("int").alias("fold"), F.lit(0).alias("side"))
    ends = ranges.join(forward.select("h").distinct(), F.lit(True))
    at = lambda c, side: ends.select("symbol", "h", c.cast(forward.schema["loc"].dataType).alias("loc"), F.lit(None).cast("double").alias("v"), F.col("fold").cast("int").alias("fold"), F.lit(side).alias("side"))
    both = sums.unionByName(at(F.col("lo") - 1, -1)).unionByName(at(F.col("hi"), 1))
    order = Window.partitionBy("symbol", "h").orderBy("loc", F.abs("side")).rowsBetween(Window.unboundedPreceding, 0)
    upto = both.withColumns({"n": F.count("v").over(order), "s": F.coalesce(F.sum("v").over(order), F.lit(0.0))}).where("side <> 0")
    signed = lambda c: F.sum(F.col("side") * F.col(c))
    return upto.groupBy("fold", "h").agg(signed("n").alias("base_n"), signed("s").alias("base_sum")).where("base_n > 0")


def training(long_events: DataFrame, of: DataFrame) -> DataFrame:
    """fold, h and of the events of earlier years n, mean, sd, mfe_anchor, mae_anchor."""
    x = F.col("fwd")
    yearly = long_events.groupBy("h", "period").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.sum("mfe").alias("f"), F.sum(F.abs("mae")).alias("a"), F.count("mfe").alias("c"))
    known = before_fold(yearly, of, ["h"], {c: F.sum(c) for c in ("n", "s", "q", "f", "a", "c")})
    n, s = F.col("n"), F.col("s")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - s * s / n) / (n - 1)))
    return known.where("c > 0").select("fold", "h", "n", F.try_divide(s, n).alias("mean"), F.when(n > 1, spread).alias("sd"), (F.col("f") / F.col("c")).alias("mfe_anchor"), (F.col("a") / F.col("c")).alias("mae_anchor"))


def select_horizon(long_events: DataFrame, of: DataFrame, train_baseline: DataFrame) -> DataFrame:
    """fold, h: the greatest (mean - baseline mean) over deviation on the train events; ties go to the least h."""
    base = train_baseline.select("fold", "h", (F.col("base_sum") / F.col("base_n")).alias("b"))
    score = training(long_events, of).join(base, ["fold", "h"]).withColumn("score", F.try_divide(F.col("mean") - F.col("b"), F.col("sd")))
    best = Window.partitionBy("fold").orderBy(F.col("score").desc_nulls_last(), "h")
    return score.withColumn("n", F.row_number().over(best)).where("n = 1").select("fold", "h", "score")


def concentration(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """The greatest share of a group in all positive group sums, and whether it passes the limit; null without a positive one."""
    sums = df.groupBy(*by, group).agg(F.sum(value).alias("s"))
    positive = sums.where("s > 0").groupBy(*by).agg((F.max("s") / F.sum("s")).alias("max_share"), F.max_by(group, F.struct("s", group)).alias("dominant"))
    return df.select(*by).distinct().join(positive, by, "left").withColumn("concentrated", F.col("max_share") > MAX_SHARE)


def is_above(x: Column, limit: float) -> Column:
    """False for what is missing or no number, which Spark would hold to be greater than any."""
    return F.coalesce((x > limit) & ~F.isnan(x), F.lit(False))


def classify(n: Column, sortino: Column, ok: Column, by_symbol: Column, by_year: Column, significant: Column, excess: Column, ratio: Column) -> Column:
    """The ordered gates of the verdict."""
    return (
        F.when(n <= MIN_REPORT, "insufficient_data")
        .when(sortino.isNull() | F.isnan(sortino), "rejected")
        .when(~F.coalesce(ok, F.lit(False)), "watch")
        .when(by_symbol.isNull() | by_year.isNull(), "watch")
        .when(by_symbol | by_year, "watch")
        .when(~F.coalesce(significant, F.lit(False)) | ~is_above(excess, 0), "rejected")
        .when(~is_above(ratio, 1), "watch")
        .otherwise("accepted")
    )


def explain(n: Column, sortino: Column, ok: Column, by_symbol: Column, by_year: Column, significant: Column, excess: Column, ratio: Column) -> Column:
    """Why a candidate is not accepted: the first gate that stops it."""
    return (
        F.when(n <= MIN_REPORT, F.concat(F.lit("only "), n.cast("string"), F.lit(" of more than 20 events")))
        .when(sortino.isNull() | F.isnan(sortino), "no trade result")
        .when(~F.coalesce(ok, F.lit(False)), "pattern test did not run")
        .when(by_symbol.isNull() | by_year.isNull(), "no positive group")
        .when(by_symbol, "one symbol carries it")
        .when(by_year, "one year carries it")
        .when(excess <= 0, "no excess return")
        .when(~F.coalesce(significant, F.lit(False)), "not better than its baseline")
        .when(~usable(excess), "no excess return")
        .when(~is_above(ratio, 1), "adverse moves outweigh favourable ones")
    )


def benjamini_hochberg(df: DataFrame, p: str = "p", weight: str | None = None, by: list[str] | None = None, alpha: float = FDR) -> DataFrame:
    """df with `survives`: step-up over the usable p-values of each family; weights are scaled to mean one."""
    by = by or []
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    family = Window.partitionBy(*by, "__usable")
    df = df.withColumn("__usable", usable)
    if weight:
        good = F.coalesce(F.col(weight) > 0, F.lit(False)) & ~F.isnan(weight)
        scaled = F.col(weight) / F.avg(F.when(good, F.col(weight))).over(family)
        df = df.withColumn("__p", F.col(p) / F.when(good, scaled).otherwise(1.0))
    else:
        df = df.withColumn("__p", F.col(p))
    # ranks come from counts of equal values, so a family is pre-aggregated before its rows meet
    counts = df.where("__usable").groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy(*by).orderBy("__p")
    total = Window.partitionBy(*by)
    ranked = counts.withColumns({"rank": F.sum("k").over(up.rowsBetween(Window.unboundedPreceding, 0)), "m": F.sum("k").over(total)})
    cut = ranked.where(F.col("__p") <= alpha * F.col("rank") / F.col("m")).groupBy(*by).agg(F.max("__p").alias("__cut"))
    joined = df.join(cut, by, "left") if by else df.join(cut, F.lit(True), "left")  # without families it is one row
    return joined.withColumn("survives", F.coalesce(F.col("__usable") & (F.col("__p") <= F.col("__cut")), F.lit(False))).drop("__usable", "__p", "__cut")


def demote(battery: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Accepted candidates of their family (a p-value, and over 20 events or an unknown count) that do not survive become rejected.

    weight: a column of prior weights, given before any outcome was seen.  by: what parts the families, if there is more than one.
    """
    member = F.col("p").isNotNull() & F.coalesce(F.col("n") > MIN_REPORT, F.lit(True))
    tested = benjamini_hochberg(battery.withColumn("__p_in", F.when(member, F.col("p"))), "__p_in", weight, by)
    demoted = member & (F.col("status") == "accepted") & ~F.col("survives")
    return tested.withColumns({"fdr_significant": F.when(member, F.col("survives")), "fdr_demoted": demoted, "status": F.when(demoted, "rejected").otherwise(F.col("status"))}).drop("__p_in", "survives")


def live_after(live: DataFrame, battery: DataFrame) -> DataFrame:
    """The live state without the candidates that the family's correction demoted."""
    return live.join(battery.where("fdr_demoted").select("candidate"), "candidate", "left_anti")


#: The normal quantile of a one-sided level of 0.05, and those of the powers in use.
Z_LEVEL, Z_POWER = 1.645, {0.8: 0.84, 0.9: 1.282}


def required_n(sd: Column, effect: float = 0.05, power: float = 0.8) -> Column:
    """Events needed to see the effect, with the variance that overlapping windows add."""
    if not 0 < power < 1:
        raise ValueError(f"a power of {power}")
    z = Z_LEVEL + Z_POWER.get(power, NormalDist().inv_cdf(power))
    return F.when((sd > 0) & ~F.isnan(sd) & F.lit(effect > 0), 6.0 * F.pow(z * sd / F.lit(effect), 2))


def prune_codes(df: DataFrame) -> DataFrame:
    """A code YYYY-0001 for each candidate, in order of its first day and name within the year."""
    w = Window.partitionBy(F.year("first_tracked")).orderBy("first_tracked", "candidate")
    return df.withColumn("code", F.concat(F.year("first_tracked").cast("string"), F.lit("-"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")))


# -- bootstrap --------------------------------------------------------------------------------------


#: An odd step and two odd multipliers of a 64-bit mixer; fixed values.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def uniforms(replicate: np.ndarray, draw: np.ndarray, which: int) -> np.ndarray:
    """Numbers in [0, 1), 53 bits, that the replicate, its draw and which of the draw's numbers decide: the same in any engine and any split of the work."""
    x = (replicate.astype(np.uint64)[:, None] << np.uint64(33)) + (draw.astype(np.uint64)[None, :] << np.uint64(1)) + np.uint64(which)
    for shift, times in ((30, FIRST), (27, SECOND)):
        x = x + np.uint64(STEP) if shift == 30 else x
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def block_bootstrap_means(chunks: list[np.ndarray], n: int, block: int, replicates: np.ndarray) -> np.ndarray:
    """Means of n values drawn in contiguous blocks, one for each replicate (a number that decides its draws).

    A place is drawn evenly among all values, which picks its chunk by length, and then a block's start in that chunk; a block is as long
    as asked for, or as its chunk.  All draws are arrays: a block's sum is a difference of prefix sums, and the block in which a
    replicate reaches n counts in part.
    """
    chunks = [np.asarray(c, float) for c in chunks if len(c)]
    size = np.array([len(c) for c in chunks])
    first = np.cumsum(size) - size
    sums = np.concatenate([[0.0], np.cumsum(np.concatenate(chunks))])
    length = np.minimum(block, size)
    total, held, done = np.zeros(len(replicates)), np.zeros(len(replicates), np.int64), 0
    while (held < n).any():
        short = np.flatnonzero(held < n)
        draws = max(1, min(-(-int(n - held.min()) // int(length.max())) + 1, 4_000_000 // len(short)))
        j = np.arange(done, done + draws)
        of = np.searchsorted(first, np.floor(uniforms(replicates[short], j, 0) * size.sum()), side="right") - 1
        start = first[of] + np.floor(uniforms(replicates[short], j, 1) * (size[of] - length[of] + 1)).astype(np.int64)
        upto = held[short, None] + np.cumsum(length[of], axis=1)
        take = np.clip(n - (upto - length[of]), 0, length[of])
        total[short] += (sums[start + take] - sums[start]).sum(axis=1)
        held[short], done = upto[:, -1], done + draws
    return total / n


SLICES = 4  # of a candidate's replicates, which run side by side


def bootstrap_p(observed: DataFrame, pool: DataFrame, reps: int = 2000) -> DataFrame:
    """candidate, n, mean, baseline_mean, baseline_n, p, p_two_sided, significant.

    observed: candidate, value, block (one for each candidate); pool: candidate, chunk, base (array, in order).  A task has one
    candidate's pool and a share of its replicates.
    """
    name = F.col("candidate").cast("string").alias("candidate")
    own = observed.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("block").alias("block"))
    joined = own.join(pool.select(name, "chunk", "base"), "candidate").withColumn("slice", F.explode(F.array(*map(F.lit, range(SLICES)))))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        chunks = [np.asarray(c, float) for c in p.sort_values("chunk")["base"]]
        n, mean, block = int(p["n"].iloc[0]), float(p["mean"].iloc[0]), int(p["block"].iloc[0])
        values = np.concatenate(chunks) if chunks else np.zeros(0)
        base = float(values.mean()) if len(values) else None
        above = beyond = drawn = None
        if len(values) >= MIN_POOL:
            means = block_bootstrap_means(chunks, n, block, np.arange(key[1], reps, SLICES))
            above, beyond, drawn = int((means >= mean).sum()), int((np.abs(means - base) >= abs(mean - base)).sum()), len(means)
        return pd.DataFrame([(key[0], base, len(values), above, beyond, drawn)], columns=["candidate", "base", "size", "above", "beyond", "drawn"])

    parts = joined.groupBy("candidate", "slice").applyInPandas(run, "candidate string, base double, size long, above long, beyond long, drawn long")
    told = parts.groupBy("candidate").agg(F.max("base").alias("baseline_mean"), F.max("size").alias("baseline_n"), (F.sum("above") / F.sum("drawn")).alias("p"), (F.sum("beyond") / F.sum("drawn")).alias("p_two_sided"))
    significant = F.when(F.col("p").isNotNull(), (F.col("p") < SIGNIFICANCE) & (F.col("mean") > F.col("baseline_mean")))
    return own.join(told, "candidate", "left").select("candidate", "n", "mean", "baseline_mean", F.coalesce("baseline_n", F.lit(0)).alias("baseline_n"), "p", "p_two_sided", significant.alias("significant"))


def keep_or_drop(n: Column, status: Column, significant: Column, sd: Column) -> Column:
    """Drop only what had the power to show an effect and did not; whatever is open or still alive stays."""
    need = required_n(sd)
    settled = (status == "accepted") | (status == "insufficient_data") | (n <= MIN_REPORT) | F.coalesce(significant, F.lit(False))
    return F.when(settled, "keep").when(F.coalesce(n >= need, F.lit(False)), "drop").otherwise("keep")


def advice_reason(n: Column, status: Column, significant: Column, sd: Column, excess: Column, symbol_share: Column, year_share: Column, ratio: Column) -> Column:
    """Why keep_or_drop says what it says."""
    need, count = required_n(sd), n.cast("string")
    share = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    held = F.when((share(symbol_share) > MAX_SHARE) | (share(year_share) > MAX_SHARE), F.when(share(symbol_share) >= share(year_share), "significant, so far mostly on one symbol").otherwise("significant, so far mostly in one year"))
    held = held.when(usable(ratio) & (ratio <= 1), "significant, but adverse moves outweigh favourable ones").otherwise("significant, held back by a robustness check")
    runs = F.when(usable(excess), F.concat(F.lit(", the effect runs "), F.format_number(100 * excess, 1), F.lit(" %"))).otherwise("")
    return (
        F.when(status == "accepted", "accepted")
        .when((status == "insufficient_data") | (n <= MIN_REPORT), F.concat(F.lit("only "), count, F.lit(" events, not yet testable")))
        .when(F.coalesce(significant, F.lit(False)), held)
        .when(n >= need, F.concat(F.lit("had the power ("), count, F.lit(" of "), F.format_number(need, 0), F.lit(") and showed nothing"), runs))
        .when(need.isNotNull(), F.concat(F.lit("undetermined: "), count, F.lit(" of "), F.format_number(need, 0), F.lit(" events")))
        .otherwise("not enough is known")
    )


def significance_text(found: dict) -> str:
    """One line for a person on a verdict's row (a mapping with the columns that a battery has)."""
    if found.get("p") is None:
        return "The pattern could not be tested: too little data."
    against = "the same market state without the event" if found.get("baseline_kind") == "incremental" else "ordinary returns of the same time"
    ratio, sortino = found.get("ratio"), found.get("sortino")
    risk = "no risk profile" if ratio is None or ratio != ratio else f"sortino {sortino:.2f}, favourable over adverse moves {ratio:.2f}" if sortino is not None else f"favourable over adverse moves {ratio:.2f}"
    wrong_way = "" if found["excess"] > 0 else " The effect runs against the direction traded."
    return f"Excess {100 * found['excess']:+.2f} % over {against} (n = {found['n']}, {found.get('baseline_n')} to compare), p = {found['p']:.3f}, {'' if found['significant'] else 'not '}significant; {risk}.{wrong_way}"


def without_nan(df: DataFrame) -> DataFrame:
    """df with null for what is no number, as documents need it."""
    return df.withColumns({c: F.when(usable(F.col(c)), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})
