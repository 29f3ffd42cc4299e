"""Bitemporal operators: what was known of a series at a time, first prints, surprises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(vintage: DataFrame, day: Column) -> DataFrame:
    """The latest revision of each period that is known on the day."""
    known = vintage.where(F.col("realtime_start") <= day)
    return known.groupBy("series", "period").agg(F.max_by("value", "realtime_start").alias("value"), F.max("realtime_start").alias("realtime_start"))


def first_prints(vintage: DataFrame) -> DataFrame:
    return vintage.groupBy("series", "period").agg(F.min_by("value", "realtime_start").alias("value"), F.min("realtime_start").alias("published"))


def surprises(vintage: DataFrame, n: int = 12, least: int = 6) -> DataFrame:
    """series, published, surprise: the change of first prints against the n changes before it.

    Null where fewer than `least` precede, or where they hardly vary against the median change.
    """
    by_time = Window.partitionBy("series").orderBy("published", "period")
    before, whole = by_time.rowsBetween(-n, -1), Window.partitionBy("series")
    first = first_prints(vintage).withColumn("delta", F.col("value") - F.lag("value").over(by_time))
    first = first.withColumns({"m": F.avg("delta").over(before), "sd": F.stddev_samp("delta").over(before), "k": F.count("delta").over(before), "floor": F.greatest(F.percentile(F.abs("delta"), F.lit(0.5)).over(whole) * 0.01, F.lit(1e-12))})
    z = F.when((F.col("k") >= least) & (F.col("sd") > F.col("floor")), (F.col("delta") - F.col("m")) / F.col("sd"))
    last = Window.partitionBy("series", "published").orderBy(F.col("period").desc())
    return first.select("series", "period", "published", z.alias("surprise")).withColumn("n", F.row_number().over(last)).where("n = 1").select("series", "published", "surprise")


def release_days(vintage: DataFrame, new_periods_only: bool = False, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """series, d: distinct days of publication within the bounds; or of first prints only."""
    days = first_prints(vintage).select("series", F.col("published").alias("d")) if new_periods_only else vintage.select("series", F.col("realtime_start").alias("d"))
    days = days if start is None else days.where(F.col("d") >= start)
    return (days if end is None else days.where(F.col("d") <= end)).distinct()


def during(vintage: DataFrame, start: Column, end: Column) -> DataFrame:
    """series, published, period, value, delta, surprise of each first print in (start, end]; windows see the whole history."""
    by_time = Window.partitionBy("series").orderBy("published", "period")
    first = first_prints(vintage).withColumn("delta", F.col("value") - F.lag("value").over(by_time))
    told = first.join(surprises(vintage), ["series", "published"], "left")
    return told.where((F.col("published") > start) & (F.col("published") <= end)).select("series", "published", "period", "value", "delta", "surprise")


def latest_with_prior(vintage: DataFrame, day: Column) -> DataFrame:
    """The two latest periods known on the day: period, value, prior."""
    w = Window.partitionBy("series").orderBy(F.col("period").desc())
    both = as_of(vintage, day).withColumns({"n": F.row_number().over(w), "prior": F.lead("value").over(w)})
    return both.where("n = 1").select("series", "period", "value", "prior")
