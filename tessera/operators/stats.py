"""Rank tests and exact tests as aggregates."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def normal_tail(z: Column) -> Column:
    """The share of a normal distribution above z, to 1e-7 (a polynomial in 1 / (1 + 0.2316419 |z|))."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    #: fixed values of that approximation
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


#: A group with a side of at most so many values and no ties gets the exact tail.
EXACT_SIDE = 8


@lru_cache(maxsize=64)
def orders_tail(small: int, large: int) -> np.ndarray:
    """For u from 0 to small * large the share of all orders of two samples, without ties, whose U is at least u.

    How many orders have which U are the coefficients of the product of (1 - q^(large + i)) / (1 - q^i) over i up to small: each factor takes away a
    shifted copy and sums up along strides.  Counts are whole numbers, exact below 2^53 and to about 1e-12 of all beyond.
    """
    counts = np.zeros(small * large + 1)
    counts[0] = 1.0
    for i in range(1, small + 1):
        counts[large + i :] -= counts[: max(0, len(counts) - large - i)].copy()
        for start in range(i):
            counts[start::i] = np.cumsum(counts[start::i])
    return counts[::-1].cumsum()[::-1] / counts.sum()


def exact_mann_whitney(u: float, n1: int, n2: int) -> float:
    """Probability of a U at least so great by chance, without ties."""
    return float(orders_tail(min(n1, n2), max(n1, n2))[int(np.ceil(u))])


def exact_tails(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """The exact probabilities of groups, a lookup for each in the table of its sizes."""
    sizes = zip(np.minimum(n1, n2).astype(int), np.maximum(n1, n2).astype(int))
    return pd.Series([float(orders_tail(small, large)[int(np.ceil(v))]) for v, (small, large) in zip(u, sizes)], dtype=float)


def average_ranks(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """df with `rank`: ties get their average; from counts of equal values, not from all rows in one window."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(counts.withColumn("rank", upto - (F.col("__k") - 1) / 2), [*by, x]).drop("__k")


def mann_whitney(df: DataFrame, x: str, treated: Column, by: list[str]) -> DataFrame:
    """U of the treated, its normal score with tie and continuity correction, and the one-sided p.

    p is exact where a side has at most EXACT_SIDE values and none are tied, else that of the score; null where a side is empty.
    """
    ranked = average_ranks(df.withColumn("__t", treated), x, by)
    ties = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("__t"), F.col("rank"))).alias("r"), F.count_if("__t").alias("n1"), F.count_if(~F.col("__t")).alias("n2")).join(ties, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    scored = sums.select(*by, "n1", "n2", "ties", u.alias("u"), F.try_divide(u - n1 * n2 / 2 - 0.5, sd).alias("z"))
    both, few = F.least("n1", "n2") > 0, (F.least("n1", "n2") <= EXACT_SIDE) & (F.col("ties") == 0)
    tail = F.pandas_udf(exact_tails, DoubleType())
    scored = scored.withColumn("__exact", tail(*[F.when(both & few, F.col(c)).otherwise(F.lit(1)).cast("double") for c in ("u", "n1", "n2")]))
    return scored.withColumn("p", F.when(both & few, F.col("__exact")).when(both, normal_tail(F.col("z")))).drop("ties", "__exact")


def log_choose(n: Column, k: Column) -> Column:
    of = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return of(n) - of(k) - of(n - k)


def fisher_one_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Probability of a table at least as extreme as ((a, b), (c, d)) towards a."""
    row, col, n = a + b, a + c, a + b + c + d
    terms = F.sequence(a.cast("int"), F.least(row, col).cast("int"))
    return F.aggregate(terms, F.lit(0.0), lambda s, k: s + F.exp(log_choose(row, k) + log_choose(n - row, col - k) - log_choose(n, col)))


def signed_rank(df: DataFrame, diff: str, by: list[str]) -> DataFrame:
    """Wilcoxon's sums of the ranks of positive and negative differences, normal score with tie correction, and two-sided p; zeros are left out."""
    ranked = average_ranks(df.where(F.col(diff) != 0).withColumn("__a", F.abs(diff)), "__a", by)
    side = lambda s: F.coalesce(F.sum(F.when(F.signum(diff) == s, F.col("rank"))), F.lit(0.0))
    ties = ranked.groupBy(*by, "__a").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), side(1).alias("w_plus"), side(-1).alias("w_minus")).join(ties, by)
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return sums.withColumn("z", z).withColumn("p", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z")))).drop("ties")
