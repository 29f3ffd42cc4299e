"""State tables on shared storage that rewrite only what a batch changes.

Rows are kept by bucket of their key's hash, a partition each.  A batch names the buckets of its keys; only these are read, merged
and written again, by Spark's dynamic partition overwrite, so a batch costs what its buckets hold and not what the table holds.
A batch with an epoch (as foreachBatch gives) leaves a marker when it is done, and one that the marker covers already changes nothing: after a
failure a stream may send its last batch again.  One writer at a time; a reader during a write may see some buckets before and others
after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.sources.state import cut, discard, insert_missing, keep_last, upsert

BUCKET = "__bucket"


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _files(self, *parts: str):
        """Hadoop's file system and a path in it: the same store that Spark writes to."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def epoch(self) -> int | None:
        """Of the last batch that is done."""
        store, folder = self._files("_epochs")
        if not store.exists(folder):
            return None
        return max((int(f.getPath().getName()) for f in store.listStatus(folder)), default=None)

    def _mark(self, epoch: int) -> None:
        store, path = self._files("_epochs", str(epoch))
        store.create(path, True).close()
        _, folder = self._files("_epochs")
        for f in store.listStatus(folder):
            if int(f.getPath().getName()) < epoch:
                store.delete(f.getPath(), False)

    def _bucketed(self) -> DataFrame:
        store, path = self._files()
        kept = store.exists(path) and any(f.isDirectory() and f.getPath().getName().startswith(f"{BUCKET}=") for f in store.listStatus(path))
        schema = StructType([*self.schema.fields]).add(BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(self.path) if kept else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._bucketed().drop(BUCKET)

    def _place(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def apply(self, batch: DataFrame, how: str = "upsert", epoch: int | None = None, order: list[Column] | None = None) -> int:
        """Merge a batch and give the number of buckets that were written.

        how: upsert (the batch's rows take the place of those of equal keys), insert (only keys that the table lacks) or discard (keys go).
        order: of rows of one key in the batch, the last of which counts; without it keys must not repeat.
        """
        done = self.epoch() if epoch is not None else None
        if done is not None and epoch <= done:
            return 0
        new = batch.select(*self.keys) if how == "discard" else batch.select(*self.schema.names)
        new = cut(self._place(keep_last(batch.select(*self.schema.names), self.keys, *order) if order and how != "discard" else new))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most `buckets` numbers
        if touched:
            old = self._bucketed().where(F.col(BUCKET).isin(touched))
            merge = {"upsert": upsert, "insert": insert_missing}.get(how)
            merged = cut(merge(old, new, self.keys) if merge else discard(old, new, *self.keys))
            left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
            merged.repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
            for bucket in set(touched) - left:  # nothing was written there, so nothing was overwritten
                store, path = self._files(f"{BUCKET}={bucket}")
                store.delete(path, True)
        if epoch is not None:
            self._mark(epoch)
        return len(touched)
