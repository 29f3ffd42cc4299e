"""Plumbing shared by the corpus operators: scratch space, lineage cuts, range splits, sizes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints/tessera"

#: Code points at which the contracts end a word, as a character class for the JVM and for RE2.
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 4 << 20
BATCH_ROWS = 1000

#: Stands for a missing doc_id where an ordering is needed: such rows come first.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, else spark.checkpoint.dir.

    Where neither is set, a local session gets one of its own; on a cluster that would be lost work, so it raises.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not have.isEmpty():
        return have.get()
    if named is None and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if have.isEmpty():
        sc.setCheckpointDir(named or LOCAL_SCRATCH)
    return named or LOCAL_SCRATCH


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These session settings, for the actions within."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brief_shuffles(spark: SparkSession):
    """For actions that run once: their shuffle files go as they end, not when the driver happens to collect its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """A checkpoint of the rows dealt by key.  Joined by it with rows that `repartition(parts, key)` deals, these stay where they are."""
    with settings(df.sparkSession, {"spark.sql.adaptive.enabled": "false"}):  # of an adaptive plan Spark does not keep how rows are dealt
        return cut(df.repartition(parts, key))


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES, so that few rows at a time are Python objects."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows)) if rows < batch.num_rows else (batch,)


def lean(run: Callable[[Iterable], Iterable]) -> Callable[[Iterable], Iterator]:
    """For mapInArrow: run over small slices, and give memory back when the task ends."""

    def wrapped(batches):
        try:
            yield from run(small(batches))
        finally:
            give_back()

    return wrapped


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again; for wide rows, as it stays compressed."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate (file sizes for a plain scan), or None where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 2**60 else None


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Enough partitions for `bytes_each` of input to one, and no fewer than the session's shuffle setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-(plan_bytes(df) or 0) // bytes_each))


def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows of a batch that Spark hands to Python: the JVM and the worker each hold it whole, and texts are large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def id_and_text(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """doc_id (long) and text (string) under names that no input column can clash with, for batches of so many rows."""
    batch_rows(df.sparkSession, rows)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_by_place(df: DataFrame, run) -> DataFrame:
    """mapInArrow from df's columns to columns of the same schema, for tables in which names may repeat; batches name columns by place."""
    batch_rows(df.sparkSession)
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(lean(run), plain.schema).toDF(*df.columns)


def id_order(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def range_splits(df: DataFrame, parts: int) -> tuple[list[int], int | None]:
    """Ascending doc_ids that occur in df and cut it into about `parts` equal ranges; and the least one.

    Range b holds the ids from splits[b - 1] to below splits[b].  Reads the id column only and sends
    one row of at most `parts` numbers to the driver.
    """
    marks = [i / parts for i in range(1, parts)] or [0.5]
    row = df.select(id_order("doc_id").alias("k")).agg(
        F.min("k").alias("least"), F.percentile_approx("k", marks, max(10_000, 20 * parts)).alias("marks")
    ).first()
    if row["least"] is None:
        return [], None
    return sorted({m for m in row["marks"] or [] if m > row["least"]}) if parts > 1 else [], row["least"]
