"""Mixing sources to target weights.

Words are summed up by source; each source has a target, and its repetition rate is the target over its
words.  A document is taken floor(rate) times, and once more if a hash-seeded draw falls below the
fraction of the rate.

Targets share a budget by weight.  A target stops at `most` times the source's words; the excess is
shared out again by weight until no target is above.  That is solved at once: in order of cap over
weight, a source is capped as long as its share of what is left would pass its cap.

All of it is DataFrame expressions; there is no Python on the executors.  Only the per-source table (one row
a source) meets in one window; hot sources are summed up before the shuffle, and joined by a broadcast
where Spark finds the table small, else by a join that it can split.

Defined results
    null text       no words; taken 0 times its size, that is 0
    null source     a source of its own, last in order
    no words        a source without words has target 0 and rate 0
    null doc_id     drawn for like an id of its own
    repeated rows   the same draw
    empty table     empty result
    extra columns   ignored by `plan`, repeated by `emit`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEED = "mix"
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that seed and id decide: 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("none")))), 1, 12), 16, 10).cast("long") / float(2**48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """no_source, source, source_size, target and rate of each source; sizes: source and size."""
    keyed = sizes.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), "size")
    per = keyed.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy("no_source", "source")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("budget100", F.sum("source_size").over(everything) * percent).withColumn("all_weight", F.sum("weight").over(everything))
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("rest100", F.col("budget100") - 100 * F.coalesce(F.sum("cap").over(tightest), F.lit(0))).withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(tightest), F.lit(0)))
    per = per.withColumn("capped", F.col("rest100") * F.col("weight") > 100 * F.col("cap") * F.col("rest_weight"))
    left = F.col("budget100") - 100 * F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    left_weight = F.col("all_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    per = per.withColumn("left", left).withColumn("left_weight", left_weight)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / (F.col("left_weight") * 100).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.withColumn("target", target).withColumn("rate", F.least(rate, F.lit(float(most)))).select("no_source", "source", "source_size", "target", "rate")


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    return (F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan(df: DataFrame, **limits) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size times copies) of every row."""
    sizes = common.cut(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    of = targets(sizes, **limits)
    keyed = sizes.select("doc_id", "size", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"))
    return keyed.join(of, ["no_source", "source"]).withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(df: DataFrame, **limits) -> DataFrame:
    """Each row of df as often as the mix takes it, with all its columns; a row without words is taken by the same draw."""
    sizes = common.cut(df.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    of = targets(sizes, **limits).select("no_source", F.col("source").alias("of_source"), "rate")
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # any names may clash
    doc_id, source = (F.col(f"c{df.columns.index(n)}") for n in ("doc_id", "source"))
    source = source.cast("string")
    mixed = plain.join(of, (source.isNull() == F.col("no_source")) & (F.coalesce(source, F.lit("")) == F.col("of_source")))
    return mixed.select(*plain.columns, F.explode(F.array_repeat(F.lit(1), copies(F.col("rate"), doc_id)))).select(*plain.columns).toDF(*df.columns)
