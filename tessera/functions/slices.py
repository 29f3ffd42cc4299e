"""Panels cut by time, so that one symbol's history is worked on by many tasks; the results are those of an uncut one.

`located` gives each row its place in the symbol's order without sorting a symbol in one task: rows are counted by
buckets of time, the counts (a row a bucket) are summed up, and a row's place is what lies before its bucket and its
rank within.  Places then cut the panel into slices of equal length.

* Frames of bounded length: `over_slices` gives each slice a halo, the rows before and after it that its frames reach.
  A row goes to the slice that owns it and to those whose halo holds it; windows run within slices, and
  only own rows come out.
* Frames from the start (`filled`, `summed`): totals of blocks meet in a second pass over a row a block.
* Recursions (`scanned`): a row is a map of the state before it.  Maps compose, and composition is associative, so
  blocks of rows fold into one map each, those into one of theirs, and so on; each row then composes what lies before
  its block with the maps of its block up to itself.

Rows need a symbol and a day or time `d`, unique within the symbol; rows where either is null are left out by `located`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.series import windows_by

#: Rows of a slice and of a block of a scan.
ROWS, BLOCK = 4096, 32


def located(df: DataFrame, rows: int = ROWS, *then: str) -> DataFrame:
    """df with loc (place in the symbol's order of d, ties by the columns named then, from 0) and n_rows (of the symbol)."""
    t = F.unix_seconds(F.col("d").cast("timestamp"))
    per = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    width = per.where(F.col("n") > rows).agg(F.min((F.col("last") - F.col("first") + 1) * rows / F.col("n"))).first()[0]
    bucket = F.lit(0) if width is None else F.floor(t / max(1, int(width)))
    placed = df.where("symbol IS NOT NULL AND d IS NOT NULL").withColumn("__bucket", bucket.cast("long"))
    order = Window.partitionBy("symbol").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("symbol", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("symbol", "__bucket", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("symbol")).alias("n_rows"))
    rank = F.row_number().over(Window.partitionBy("symbol", "__bucket").orderBy("d", *then))
    return placed.join(before, ["symbol", "__bucket"]).withColumn("loc", F.col("__before") + rank - 1).drop("__bucket", "__before")


def with_halos(df: DataFrame, back: int, ahead: int, rows: int = ROWS) -> DataFrame:
    """df (located) with __slice and __own: each row in the slice that owns it and in those that it is at most `back` rows before or `ahead` after."""
    first, last = F.greatest(F.lit(0), F.col("loc") - ahead), F.least(F.col("n_rows") - 1, F.col("loc") + back)
    cut = df.withColumn("__slice", F.explode(F.sequence(F.floor(first / rows), F.floor(last / rows))))
    return cut.withColumn("__own", F.floor(F.col("loc") / rows) == F.col("__slice"))


def over_slices(df: DataFrame, build: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """build(df), whose frames over `by_day()` reach `back` rows before and `ahead` after a row, counted through all frames that
    build on each other.  df: located.  build keeps the rows and the columns __slice and __own."""
    with windows_by("symbol", "__slice"):
        return build(with_halos(df, back, ahead, rows)).where("__own").drop("__slice", "__own")


def _upto(at: str, *by: str):
    return Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)


def _with_blocks_before(df: DataFrame, inner: dict[str, Column], total: dict[str, Column], before: dict[str, Callable[[Column], Column]], rows: int) -> DataFrame:
    """df with the inner columns over the rows of a block, and as `__name` what the blocks before hold."""
    blocked = df.withColumn("__block", F.floor(F.col("loc") / rows)).withColumns(inner)
    totals = blocked.groupBy("symbol", "__block").agg(*[c.alias(f"__{n}") for n, c in total.items()])
    order = Window.partitionBy("symbol").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    known = totals.select("symbol", "__block", *[before[n](F.col(f"__{n}")).over(order).alias(f"__{n}") for n in total])
    return blocked.join(known, ["symbol", "__block"])


def filled(df: DataFrame, *names: str, rows: int = ROWS) -> DataFrame:
    """df (located) with the last non-null value up to each row in the place of the named columns."""
    w = _upto("loc", "symbol", "__block")
    inner = {n: F.last(n, ignorenulls=True).over(w) for n in names}
    met = _with_blocks_before(df, inner, {n: F.max_by(n, "loc") for n in names}, {n: lambda c: F.last(c, ignorenulls=True) for n in names}, rows)
    return met.withColumns({n: F.coalesce(n, f"__{n}") for n in names}).select(*df.columns)


def carried(known: DataFrame, onto: DataFrame, *values: str, rows: int = ROWS) -> DataFrame:
    """onto (symbol, t, ...) with the values of the last row of known (symbol, t) at or before t, without a range join."""
    left = known.select("symbol", F.col("t").alias("d"), F.lit(0).alias("__side"), F.struct(*values).alias("__known"))
    right = onto.select(F.struct(*onto.columns).alias("__row"), "symbol", F.col("t").alias("d"), F.lit(1).alias("__side"))
    both = located(left.unionByName(right, allowMissingColumns=True), rows, "__side")
    return filled(both, "__known", rows=rows).where("__side = 1").select("__row.*", *(F.col(f"__known.{v}").alias(v) for v in values))


def summed(df: DataFrame, sums: dict[str, Column], rows: int = ROWS) -> DataFrame:
    """df (located) with the sum of each column over all rows up to each one."""
    w = _upto("loc", "symbol", "__block")
    inner = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}
    met = _with_blocks_before(df, inner, {n: F.max_by(n, "loc") for n in sums}, {n: F.sum for n in sums}, rows)
    return met.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}).select(*df.columns, *sums)


@dataclass(frozen=True)
class Step:
    """A row as a map of the state s before it: first where there is none yet, else a * s + b."""

    a: Column
    b: Column
    first: Column

    def parts(self, name: str) -> list[Column]:
        return [c.cast("double").alias(f"{k}_{name}") for k, c in (("a", self.a), ("b", self.b), ("first", self.first))]


def mean_step(x: Column, weight: float) -> Step:
    """The exponential mean that gives the newest value this weight and starts at the first one; a null leaves it as it is."""
    return Step(F.when(x.isNull(), 1.0).otherwise(1.0 - weight), F.coalesce(weight * x, F.lit(0.0)), x)


def count_step(x: Column) -> Step:
    """How many values there were."""
    one = x.isNotNull().cast("double")
    return Step(F.lit(1.0), one, one)


def _then(m: Column, after: Column, names: list[str]) -> Column:
    """One map after another, as one."""
    fields = []
    for n in names:
        a, b = after[f"a_{n}"], after[f"b_{n}"]
        first = F.coalesce(a * m[f"first_{n}"] + b, after[f"first_{n}"])
        fields += [(a * m[f"a_{n}"]).alias(f"a_{n}"), (a * m[f"b_{n}"] + b).alias(f"b_{n}"), first.alias(f"first_{n}")]
    return F.struct(*fields)


def _prefixes(df: DataFrame, by: list[str], at: str, names: list[str], longest: int, level: int = 0) -> DataFrame:
    """df (by, at, __map) with __upto, all maps up to each row as one."""
    unit = F.struct(*[x.alias(f"{k}_{n}") for n in names for k, x in (("a", F.lit(1.0)), ("b", F.lit(0.0)), ("first", F.lit(None).cast("double")))])
    folded = lambda w: F.aggregate(F.collect_list("__map").over(w), unit, lambda m, x: _then(m, x, names))
    if longest < BLOCK:
        return df.withColumn("__upto", folded(_upto(at, *by)))
    block = f"__block{level}"
    inner = df.withColumn(block, F.floor(F.col(at) / BLOCK)).withColumn("__upto", folded(_upto(at, *by, block)))
    totals = inner.groupBy(*by, block).agg(F.max_by("__upto", at).alias("__map"))
    known = _prefixes(totals, by, block, names, longest // BLOCK, level + 1)
    before = known.select(*by, (F.col(block) + 1).alias(block), F.col("__upto").alias("__before"))
    met = inner.join(before, [*by, block], "left")
    return met.withColumn("__upto", F.when(F.col("__before").isNull(), F.col("__upto")).otherwise(_then(F.col("__before"), F.col("__upto"), names))).drop("__before", block)


def scanned(df: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """df (located) with the state after each row, for each name; null before its first value."""
    names = list(steps)
    longest = df.agg(F.max("loc")).first()[0] or 0
    maps = df.withColumn("__map", F.struct(*[c for n, s in steps.items() for c in s.parts(n)]))
    return _prefixes(maps, ["symbol"], "loc", names, longest).withColumns({n: F.col(f"__upto.first_{n}") for n in names}).drop("__map", "__upto")
