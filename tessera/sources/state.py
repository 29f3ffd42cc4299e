"""State tables: append, upsert, keep-last, park and unpark, atomic documents."""

from __future__ import annotations

import json
import os
import socket
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last in the order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of new in place of those with the same keys."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base, and the rows of new whose keys it lacks."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti"))


def append_numbered(base: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """new appended with ids that go on from base's greatest; new is a batch of a few rows."""
    top = base.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("__top"))
    numbered = new.withColumn("__n", F.row_number().over(Window.orderBy(*order))).join(top, F.lit(True))
    return base.unionByName(numbered.withColumn("id", F.col("__top") + F.col("__n")).drop("__n", "__top"))


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires) > now)


def discard(df: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """df without the rows of the keys."""
    return df.join(keys.select(*names).distinct(), list(names), "left_anti")


def due(queue: DataFrame, when: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """What has come due, and what stays queued."""
    arrived = F.coalesce(F.col(when) <= now, F.lit(False))
    return queue.where(arrived), queue.where(~arrived)


def with_flags(state: DataFrame, changes: DataFrame, key: str, *flags: str) -> DataFrame:
    """state with the flags that changes name; null there leaves a flag as it is, and keys that state lacks are added."""
    new = changes.select(key, *[F.col(f).alias(f"__{f}") for f in flags])
    both = state.join(new, key, "full")
    return both.withColumns({f: F.coalesce(f"__{f}", f) for f in flags}).select(*state.columns)


def migrated_registry(entries: DataFrame) -> DataFrame:
    """candidate, spec, status, registered_at: the status is the last of the log, else insufficient_data; entries never tracked go."""
    last = F.try_element_at("status_log", F.lit(-1))["status"]
    return entries.where("first_tracked_at IS NOT NULL").select("candidate", F.struct(F.col("spec").alias("spec")).alias("spec"), F.coalesce(last, F.lit("insufficient_data")).alias("status"), iso(F.col("first_tracked_at")).alias("registered_at"))


def migrated_history(entries: DataFrame) -> DataFrame:
    """candidate, first_tracked_at and status_log with days as moments in UTC."""
    log = F.transform(F.coalesce("status_log", F.array()), lambda e: F.struct(e["status"].alias("status"), iso(e["at"]).alias("at")))
    return entries.where("first_tracked_at IS NOT NULL").select("candidate", iso(F.col("first_tracked_at")).alias("first_tracked_at"), log.alias("status_log"))


def iso(day: Column) -> Column:
    return F.date_format(day.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints/tessera")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that plans built on it stay small and lost executors cost no more than a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_json(path: str | Path, data: Any) -> None:
    """Replace a small document at once: a reader sees the old or the new one, and one that JSON cannot hold changes nothing."""
    text, path = json.dumps(data, allow_nan=False), Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=path.parent) as folder:
        draft = Path(folder, path.name)
        with draft.open("w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        draft.replace(path)


def read_json(path: str | Path, default: Any) -> Any:
    """The document, or default where there is none; a corrupt one raises."""
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else default


class Locked(RuntimeError):
    """Another live process holds the lock."""


@contextmanager
def lock(path: str | Path, lease: float = 6 * 3600.0) -> Iterator[None]:
    """One process at a time, on whichever machine: the file names the holder's host, process and the end of its lease.

    A lock is taken over when its lease has ended, or before that if its process is of this host and gone; a holder elsewhere cannot be looked at.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    own = {"host": socket.gethostname(), "pid": os.getpid(), "until": time.time() + lease}
    while True:
        try:
            with path.open("x") as f:
                json.dump(own, f)
            break
        except FileExistsError:
            try:
                held = json.loads(path.read_text())
                here = held["host"] == own["host"]
                gone = here and (held["pid"] == own["pid"] or not Path(f"/proc/{held['pid']}").exists())
                ended = gone or held["until"] < time.time()
            except (FileNotFoundError, ValueError, KeyError, TypeError):
                held, ended = {}, True
            if not ended:
                raise Locked(f"{path} is held by process {held['pid']} of {held['host']}") from None
            path.unlink(missing_ok=True)
    try:
        yield
    finally:
        if path.exists() and path.read_text() == json.dumps(own):
            path.unlink()
