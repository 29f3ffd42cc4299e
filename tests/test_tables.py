"""State tables by bucket: what a batch does not touch keeps its files."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources.tables import StateTable

SCHEMA = "k int, v string, n int"


def files(path: Path) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in path.glob("__bucket=*")}


def rows(table) -> set[tuple]:
    got = [tuple(r) for r in table.read().collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = tmp_path / "state"
    table = StateTable(spark, str(path), SCHEMA, ["k"], 16)
    assert rows(table) == set()
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert table.apply(frame(*[(k, "a", k) for k in range(300)])) == 16
    before = files(path)
    assert table.apply(frame((7, "b", 1), (1000, "new", 2))) in (1, 2)
    after = files(path)
    changed = {b for b in before if before[b] != after[b]}
    assert 1 <= len(changed) <= 2 and set(before) == set(after)
    assert rows(table) == {(k, "a", k) for k in range(300) if k != 7} | {(7, "b", 1), (1000, "new", 2)}
    plan = table._bucketed().where("__bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan


def test_inserts_discards_and_emptied_buckets(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), SCHEMA, ["k"], 8)
    table.apply(spark.createDataFrame([(k, "a", 0) for k in range(5)] + [(None, "none", 0)], SCHEMA))
    table.apply(spark.createDataFrame([(2, "b", 1), (9, "b", 1)], SCHEMA), "insert")
    assert rows(table) == {(k, "a", 0) for k in range(5)} | {(9, "b", 1), (None, "none", 0)}
    table.apply(spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 77)], "k int"), "discard")
    assert rows(table) == {(9, "b", 1), (None, "none", 0)}
    last = spark.createDataFrame([(9, "x", 3), (9, "y", 5), (9, "z", 4)], SCHEMA)
    table.apply(last, order=[F.col("n")])
    assert rows(table) == {(9, "y", 5), (None, "none", 0)}


def test_a_batch_that_was_done_changes_nothing(spark, tmp_path):
    path = tmp_path / "s"
    table = StateTable(spark, str(path), SCHEMA, ["k"], 4)
    batch = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert table.epoch() is None and table.apply(batch, epoch=0) == 1 and table.epoch() == 0
    table.apply(spark.createDataFrame([(1, "later", 2)], SCHEMA), epoch=1)
    kept = files(path)
    assert table.apply(batch, epoch=0) == 0 and table.apply(batch, epoch=1) == 0 and files(path) == kept and rows(table) == {(1, "later", 2)}
    again = StateTable(spark, str(path), SCHEMA, ["k"], 4)  # of a new process
    assert again.epoch() == 1 and again.apply(batch, epoch=2) == 1 and rows(again) == {(1, "a", 1)}


@pytest.mark.parametrize("seed", range(2))
def test_batches_against_a_dictionary(spark, tmp_path, seed):
    rng, want = random.Random(seed), {}
    table = StateTable(spark, str(tmp_path / "s"), SCHEMA, ["k"], 8)
    for epoch in range(5):
        how = rng.choice(["upsert", "insert", "discard", "upsert"])
        batch = {rng.randrange(40): (str(epoch), rng.randrange(9)) for _ in range(rng.randrange(1, 9))}
        table.apply(spark.createDataFrame([(k, *v) for k, v in batch.items()], SCHEMA), how, epoch)
        want = {k: v for k, v in want.items() if k not in batch} if how == "discard" else want | batch if how == "upsert" else batch | want
    assert rows(table) == {(k, *v) for k, v in want.items()}


def test_as_the_sink_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    table = StateTable(spark, str(tmp_path / "s"), SCHEMA, ["k"], 4)
    for k in range(3):
        spark.createDataFrame([(1, f"v{k}", k), (10 + k, "own", k)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(lambda df, epoch: table.apply(df, epoch=epoch) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(table) == {(1, "v2", 2), (10, "own", 0), (11, "own", 1), (12, "own", 2)} and table.epoch() == 2
