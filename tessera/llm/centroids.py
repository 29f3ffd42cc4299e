"""Centroid clustering of embeddings in whole numbers, by matrix products.

A component x becomes the integer floor(1024 * x).  Squared distances are |x|^2 - 2 x.c + |c|^2, with the products
of a block of vectors as one float64 matrix product.  Before each block the largest magnitudes of its vectors and
of the centroids are checked: below 2^53 every partial sum is a whole number that a double holds, so the result is
exact in any order of the sums; below 2^63 the same is done in longs, and else in Python's integers.

The vectors are packed once into blocks (narrow integers, a table in the shared folder); each round is one
treeAggregate over them that adds sums and counts of each centroid, of a size that the rows do not change.  No
vector is shuffled.  Centroids (a few whole numbers) travel in the tasks' closures.  Rounds that move no centroid
end the iteration early, as all that follow would be the same.

Defined results
    other than `length` components, null vector, null or non-finite component    left out
    ties                    the centroid of the smaller number; start: equal hashes (repeated ids) by components
    repeated rows           each counts and is assigned
    null vec_id             counts and is assigned, but starts no centroid
    fewer vectors than k    as many centroids as there are vectors with ids; none (only null ids): no result
    empty centroid          stays where it is
    empty table             empty result
    numbers beyond a long   exact in the iteration; a distance or inertia that a long cannot hold is null
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE, LENGTH, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
BLOCK = 4096
#: What a block's vectors are kept as.
KINDS = ("<i1", "<i2", "<i4", "<i8")


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component): longs where they hold it, else Python's integers."""
    x = vectors.whole_numbers(rows, scale)
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in rows.tolist()], object).reshape(rows.shape) if x is None else x


def most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def fitting(limit: int) -> type:
    """The type whose arithmetic is exact for whole numbers below limit."""
    return np.float64 if limit < 2**53 else np.int64 if limit < 2**63 else object


def nearest(x: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance of each vector of a block, exactly."""
    limit = x.shape[1] * (most(x) + max(abs(v) for c in centres for v in c)) ** 2
    kind = fitting(limit)
    x, c = x.astype(kind), np.array(centres, object).astype(kind)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    to = far.argmin(axis=1)  # the first of equals
    return to, far[np.arange(len(x)), to].astype(object if kind is object else np.int64)


def grouped(x: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """Sums of the vectors of each centroid."""
    kind = fitting(len(x) * most(x))
    member = (to[None, :] == np.arange(k)[:, None]).astype(kind)
    return (member @ x.astype(kind)).astype(object if kind is object else np.int64)


class Sums:
    """Counts, sums of components and of distances by centroid: what treeAggregate adds up."""

    def __init__(self, k: int, length: int) -> None:
        self.count, self.far, self.total = [0] * k, [0] * k, [[0] * length for _ in range(k)]

    def block(self, x: np.ndarray, centres: list[list[int]]) -> Sums:
        to, far = nearest(x, centres)
        for k, row in enumerate(grouped(x, to, len(centres)).tolist()):
            mine = to == k
            self.count[k] += int(mine.sum())
            self.far[k] += sum(far[mine].tolist())
            self.total[k] = [a + b for a, b in zip(self.total[k], row)]
        return self

    def merge(self, other: Sums) -> Sums:
        self.count = [a + b for a, b in zip(self.count, other.count)]
        self.far = [a + b for a, b in zip(self.far, other.far)]
        self.total = [[a + b for a, b in zip(p, q)] for p, q in zip(self.total, other.total)]
        return self


def of_length(batches: Iterable[pa.RecordBatch], length: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for ids, rows in vectors.matrices(batches):
        if rows.shape[1] == length:
            for k in range(0, len(rows), BLOCK):
                yield ids.slice(k, BLOCK), integers(rows[k : k + BLOCK], scale)


def blocks(df: DataFrame, scale: int, length: int) -> DataFrame:
    """The vectors in blocks: what their numbers are kept as, and these."""

    def packed(x: np.ndarray) -> pa.RecordBatch:
        kind = next((t for t in KINDS if most(x) < 2 ** (8 * int(t[2]) - 1)), "text")
        raw = ",".join(map(str, x.ravel().tolist())).encode() if kind == "text" else x.astype(kind).tobytes()
        return pa.record_batch([pa.array([kind]), pa.array([raw], pa.binary())], ["kind", "raw"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, x in of_length(batches, length, scale):
            held.append(x)
            rows += len(x)
            if rows >= BLOCK:
                yield packed(np.concatenate(held))
                held, rows = [], 0
        if held:
            yield packed(np.concatenate(held))

    return vectors.id_and_vector(df).mapInArrow(run, "kind string, raw binary")


def unpacked(kind: str, raw: bytes, length: int) -> np.ndarray:
    x = np.array([int(v) for v in raw.decode().split(",")], object) if kind == "text" else np.frombuffer(raw, kind).astype(np.int64)
    return x.reshape(-1, length)


def start(df: DataFrame, k: int, scale: int, length: int, seed: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of seed and id."""
    narrow = vectors.id_and_vector(df).where(F.col("vec_id").isNotNull() & (F.size("embedding") == length))
    fine = narrow.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = fine.orderBy(order, "embedding").limit(k).select(F.col("embedding").cast("array<double>")).collect()
    return [integers(np.array([r[0]]), scale)[0].tolist() for r in first]


def fit(df: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> tuple[list[list[int]], Sums]:
    """The last centroids, and counts and sums of the final assignment to them; no centroids for a table without vectors."""
    centres = start(df, k, scale, length, seed)
    if not centres:
        return [], Sums(0, length)
    rdd = common.scratch_table(blocks(df, scale, length), "vector-blocks").rdd

    def assigned(at: list[list[int]]) -> Sums:
        zero = Sums(len(at), length)
        return rdd.treeAggregate(zero, lambda s, r: s.block(unpacked(r[0], bytes(r[1]), length), at), lambda a, b: a.merge(b), depth=2 if rdd.getNumPartitions() < 1000 else 3)

    for _ in range(rounds):
        s = assigned(centres)
        moved = [[v // n for v in total] if n else centre for n, total, centre in zip(s.count, s.total, centres)]
        if moved == centres:
            return centres, s
        centres = moved
    return centres, assigned(centres)


def as_long(v: int) -> int | None:
    return v if v < 2**63 else None


def assign(df: DataFrame, centres: list[list[int]], sums: Sums, scale: int = SCALE, length: int = LENGTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    by_cluster, whole = [as_long(v) for v in sums.far], as_long(sum(sums.far))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in of_length(batches, length, scale) if centres else ():
            to, far = nearest(x, centres)
            at = pa.array(to)
            distance = pa.array([as_long(v) for v in far.tolist()], pa.int64()) if far.dtype == object else pa.array(far, pa.int64())
            yield pa.record_batch([ids, at.cast(pa.int32()), distance, pa.array(by_cluster, pa.int64()).take(at), pa.array([whole] * len(x), pa.int64()), pa.array(names).take(at)], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.id_and_vector(df).mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
