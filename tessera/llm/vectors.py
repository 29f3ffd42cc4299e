"""Embedding vectors as numpy matrices: what the vector operators share.

A vector takes part if it is not null, not empty and holds neither nulls nor non-finite entries.  Columns are
taken by name, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one vector's entries, by the letter that leads its packed form.
WIDTHS = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<i8"}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def kind_of(*frames: DataFrame) -> str:
    """The type that the entries of all these are read as: floats stay floats, any other numbers become doubles."""
    return "float" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in frames) else "double"


def id_and_vector(df: DataFrame, kind: str | None = None) -> DataFrame:
    """vec_id (long) and embedding."""
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind or kind_of(df)}>").alias("embedding"))


def matrices(batches: Iterable[pa.RecordBatch], double: bool = True) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Of batches of id_and_vector: the ids and the rows of the vectors that take part, those of each length by themselves."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
        values = values.astype(np.float64) if double or values.dtype.kind != "f" else values
        starts = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == length)
            rows = values[starts[at][:, None] + np.arange(length)]
            fine = np.isfinite(rows).all(axis=1)
            if fine.any():
                yield ids.take(pa.array(at[fine])), rows[fine]


def whole_numbers(rows: np.ndarray, scale: int) -> np.ndarray | None:
    """floor(scale * entry) as longs, for a scale that is a power of two; None if an entry has none that a long can hold."""
    with np.errstate(over="ignore"):
        out = np.floor(rows * float(scale))
    return out.astype(np.int64) if np.abs(out).max(initial=0.0) < 2.0**63 else None


def pack(x: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """One binary a row, equal for equal rows only: the least width that holds the row's entries, then these.  Gives the order of the rows."""
    widest = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
    width = np.select([widest < 2**7, widest < 2**15, widest < 2**31], [1, 2, 4], 8)
    order, out = [], []
    for w, kind in WIDTHS.items():
        at = np.flatnonzero(width == w)
        if len(at):
            size = 1 + w * x.shape[1]
            raw = np.empty((len(at), size), np.uint8)
            raw[:, 0] = w
            raw[:, 1:] = np.ascontiguousarray(x[at].astype(kind)).view(np.uint8)
            out.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * size).astype(np.int32)), pa.py_buffer(raw)]))
            order.append(at)
    return np.concatenate(order), out


def unpack(packed: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows (longs) of packed vectors, by length and width."""
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    starts = np.cumsum(sizes) - sizes
    widths = raw[starts] if len(sizes) else sizes
    for size, w in sorted(set(zip(sizes.tolist(), widths.tolist()))):
        at = np.flatnonzero((sizes == size) & (widths == w))
        yield at, np.ascontiguousarray(raw[starts[at][:, None] + np.arange(1, size)]).view(WIDTHS[w]).astype(np.int64)


def digests(rows: np.ndarray) -> np.ndarray:
    """A long for each vector; equal vectors have equal ones."""
    rows = np.ascontiguousarray(rows + 0.0)  # one zero only
    return np.fromiter((xxhash.xxh3_64_intdigest(r.data) for r in rows), np.uint64, len(rows)).view(np.int64)
