"""Days that lie apart against a loop over each key's days."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators.spacing import spaced

START = dt.date(2000, 1, 1)


def by_hand(days, apart):
    out, per = set(), defaultdict(set)
    for *key, d in days:
        if d is not None:
            per[tuple(key)].add(d)
    for key, found in per.items():
        last = None
        for d in sorted(found):
            if last is None or (d - last).days >= apart(key):
                last = d
                out.add((*key, d))
    return out


@pytest.mark.parametrize("rows,apart,seed", [(8, 1, 1), (8, 7, 2), (16, 21, 3), (5, 40, 4), (4096, 21, 5), (32, 0, 6)])
def test_property(spark, rows, apart, seed):
    """Dense and thin keys, a hot one over many slices, repeated and null days, null keys."""
    rng = random.Random(seed)
    days = [("hot", "x", START + dt.timedelta(days=k)) for k in range(700) if rng.random() < 0.8]
    days += [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), START + dt.timedelta(days=rng.randrange(4000))) for _ in range(400)]
    days += [("gap", "x", START + dt.timedelta(days=500 * k)) for k in range(30)] + [("a", "x", None), ("one", "x", START)] + days[:50]
    df = spark.createDataFrame(days, "label string, coin string, d date").repartition(3)
    got = [tuple(r) for r in spaced(df, ["label", "coin"], apart, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(days, lambda _: apart)


def test_a_distance_for_each_key(spark):
    days = [(k, START + dt.timedelta(days=n)) for k in ("p3", "p50", "p9") for n in range(0, 400, 2)]
    df = spark.createDataFrame(days, "label string, d date").withColumn("apart", F.substring("label", 2, 9).cast("int"))
    assert {tuple(r) for r in spaced(df, ["label"], F.col("apart"), 16).collect()} == by_hand(days, lambda key: int(key[0][1:]))


def test_a_long_key_is_many_tasks(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("k").alias("key"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    got = spaced(df, ["key"], 7, 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.count() == -(-n // 7) and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.max(F.date_diff("d", F.lit("1900-01-01").cast("date")) % 7)).first()[0] == 0


def test_nothing(spark):
    assert spaced(spark.createDataFrame([], "key string, d date"), ["key"], 3).count() == 0
