"""Nearest neighbours by a block matrix join of int8 codes.

A query set meets all candidates in tiles.  Queries are dealt by hash into groups of at most GROUP_BYTES, candidates
are packed into blocks of up to BLOCK vectors where they are read, and blocks are dealt into strips; the task of a
tile (group, strip) holds its group and streams the blocks of its strip, so its memory is bounded whatever the
tables' size.  Every query meets every candidate, whatever its direction: the result is exact.

A unit vector u is coded as s * q, with q of whole numbers from -127 to 127, and the length of what that leaves out,
r = |u - s * q|, is kept.  The product of two codes' matrices, a whole number below 2^24 up to 1,040 entries and so
exact in float32, gives the cosine within |s q| r' + r (with SLACK for rounding).  In each tile, a pair survives if
its upper bound reaches both the k-th largest lower bound of the query in the block and the k-th score of its heap.
Survivors are recomputed as cosines in double precision from the vectors themselves and merged into the query's
heap of k; the heaps of all strips are merged by query at the end.

Equal vectors of a block meet the queries once: only their k + 1 smallest ids can be among the k nearest of a query
with an id of its own, so hot groups of copies make neither survivors nor heaps grow.

Defined results
    null, empty or zero vector, null or non-finite components    takes no part, as query or as candidate
    vectors of several lengths    meet those of their own length only
    ties                          smaller vec_id first, null last
    repeated rows                 rows of equal vec_id and equal vector count once, as query and as candidate
    one vec_id, several vectors   several candidates; as queries each has its own result, under the same query_id
    rows with the query's vec_id  are the query's own and not its candidates
    null vec_id                   a candidate (returned as null, as 2^63 - 1 is), never a query
    few candidates                all of them
    empty table                   empty result
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors

K = 5
EVERY = 50
BLOCK = 4096
PANEL = 256
#: Bytes of the vectors of one group of queries, as they are stored, and least bytes of candidates for one more strip.
GROUP_BYTES, STRIP_BYTES = 16 << 20, 8 << 20
#: Strips that even a small table is dealt into.
FEW_STRIPS = 16
#: Survivors that are recomputed at a time.
PAIRS = 1 << 15
SLACK = np.float32(4e-6)
#: Stands for a missing vec_id, so that it comes last among ties.
NONE = np.iinfo(np.int64).max
NUMBERS = {"float": "<f4", "double": "<f8"}


class Coded:
    """Vectors with their lengths, codes, scales and what the codes leave out."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        power = np.frexp(np.abs(rows).max(axis=1).astype(np.float64))[1]
        self.scaled = np.ldexp(rows.astype(np.float64), -power[:, None])  # exact, and far from overflow
        self.length = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        unit = self.scaled / self.length[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / scale[:, None])
        lost = unit - codes * scale[:, None]
        self.codes = codes.astype(np.int8)
        self.scale = scale.astype(np.float32)
        self.lost = np.sqrt((lost * lost).sum(axis=1)).astype(np.float32)
        self.kept = np.sqrt(((codes * scale[:, None]) ** 2).sum(axis=1)).astype(np.float32)

    def factors(self, part: slice = slice(None)) -> np.ndarray:
        """The codes as floats of a width in which their products are exact."""
        return self.codes[part].astype(np.float32 if self.codes.shape[1] <= 1040 else np.float64)

    def cosines(self, other: Coded, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """In double precision, summed alike wherever a pair stands."""
        return (self.scaled[mine] * other.scaled[theirs]).sum(axis=1) / (self.length[mine] * other.length[theirs]) + 0.0


class Block(Coded):
    """Candidates of which equal vectors are one row with their k + 1 smallest ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        rows = np.ascontiguousarray(rows + rows.dtype.type(0))
        keys = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        super().__init__(rows[first])
        pairs = np.unique(np.stack([of.ravel(), ids], axis=1), axis=0)  # by vector, then by id
        rank = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
        pairs = pairs[rank <= k]
        self.of, self.ids = pairs[:, 0], pairs[:, 1]
        self.starts = np.searchsorted(self.of, np.arange(len(first) + 1))
        self.by_id = np.argsort(self.ids, kind="stable")

    def holding(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids, and the rows here that hold the id."""
        held = self.ids[self.by_id]
        low, high = np.searchsorted(held, ids), np.searchsorted(held, ids, "right")
        at = np.repeat(np.arange(len(ids)), high - low)
        return at, self.of[self.by_id[np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[at]]]


class Heaps:
    """The k best of each query: scores, ids and vectors' digests, best first."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score = k, np.full((n, k), -np.inf)
        self.id, self.key = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def push(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        touched = np.unique(of)
        of = np.concatenate([of, np.repeat(touched, self.k)])
        score, ids, keys = (np.concatenate([new, old[touched].ravel()]) for new, old in ((score, self.score), (ids, self.id), (keys, self.key)))
        order = np.lexsort([keys, ids, -score, of])
        of, score, ids, keys = of[order], score[order], ids[order], keys[order]
        again = np.zeros(len(of), bool)
        again[1:] = (of[1:] == of[:-1]) & (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (score[1:] > -np.inf)
        of, score, ids, keys = of[~again], score[~again], ids[~again], keys[~again]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = rank < self.k
        self.score[touched], self.id[touched], self.key[touched] = -np.inf, NONE, 0
        for into, values in ((self.score, score), (self.id, ids), (self.key, keys)):
            into[of[best], rank[best]] = values[best]


class Group(Coded):
    """Queries of a tile with their heaps."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        super().__init__(rows)
        self.ids, self.keys, self.heaps = ids, vectors.digests(rows), Heaps(len(ids), k)

    def meet(self, block: Block) -> None:
        """One row of tiles: all queries against the block."""
        k, theirs = self.heaps.k, block.factors().T
        own = block.holding(self.ids)
        digests = None
        for low in range(0, len(self.ids), PANEL):
            part = slice(low, low + PANEL)
            near = self.factors(part) @ theirs  # whole numbers
            near *= block.scale[None, :]
            scale, kept, lost = (x[part, None] for x in (self.scale, self.kept, self.lost))
            floor = self.heaps.score[part, -1]
            if near.shape[1] > k and (floor == -np.inf).any():
                least = near * scale - kept * block.lost[None, :] - (lost + SLACK)
                mine = (own[0] >= low) & (own[0] < low + PANEL)
                least[own[0][mine] - low, own[1][mine]] = -np.inf
                floor = np.maximum(floor, np.partition(least, -k, axis=1)[:, -k])
            # the loosest bound of the block first, one comparison an entry; then each pair's own
            reach = (floor[:, None] - 2 * SLACK - lost - kept * block.lost.max()) / scale
            of, at = np.nonzero(near >= reach.astype(near.dtype))
            upper = near[of, at] * self.scale[part][of] + self.kept[part][of] * block.lost[at] + self.lost[part][of] + SLACK
            still = upper >= floor[of] - SLACK
            of, at = of[still], at[still]
            for p in range(0, len(of), PAIRS):
                o, a = of[p : p + PAIRS] + low, at[p : p + PAIRS]
                digests = vectors.digests(block.rows) if digests is None else digests
                score = self.cosines(block, o, a)
                copies = block.starts[a + 1] - block.starts[a]
                each = np.repeat(np.arange(len(o)), copies)
                ids = block.ids[np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies) + block.starts[a][each]]
                other = ids != self.ids[o[each]]
                if other.any():
                    self.heaps.push(o[each][other], score[each][other], ids[other], digests[a[each][other]])

    def found(self) -> pa.RecordBatch:
        at, rank = np.nonzero(self.heaps.score > -np.inf)
        ids = self.heaps.id[at, rank]
        return pa.record_batch([pa.array(self.ids[at]), pa.array(self.keys[at]), pa.array(ids, mask=ids == NONE), pa.array(self.heaps.key[at, rank]), pa.array(self.heaps.score[at, rank])], ["query_id", "query_key", "vec_id", "vec_key", "score"])


def blocks(df: DataFrame, side: int, kind: str, tile: Column, size: int = BLOCK) -> DataFrame:
    """Packed vectors of one deal and length: side, length, ids, raw numbers, and a row for each tile that `tile` (of deal and part, a number of the block) names.

    df: vec_id, embedding and deal.
    """
    letter = NUMBERS[kind]

    def packed(length: int, deal: int, ids: list[np.ndarray], rows: list[np.ndarray], part: int) -> pa.RecordBatch:
        raw = [np.concatenate(ids).tobytes(), np.concatenate(rows).astype(letter).tobytes()]
        return pa.record_batch([pa.array([side], pa.int32()), pa.array([length], pa.int32()), pa.array([deal], pa.int32()), *(pa.array([r], pa.binary()) for r in raw), pa.array([part], pa.int64())], ["side", "length", "deal", "ids", "raw", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() * 7919, {}
        for batch in batches:
            for deal in pc.unique(batch.column(2)).to_pylist():
                for ids, rows in vectors.matrices([batch.filter(pc.equal(batch.column(2), deal))], double=False):
                    fine = np.flatnonzero((rows != 0).any(axis=1))
                    ids, rows = pc.fill_null(ids, NONE).to_numpy()[fine], rows[fine]
                    while len(rows):
                        have = held.setdefault((rows.shape[1], deal), ([], []))
                        take = size - sum(map(len, have[0]))
                        have[0].append(ids[:take])
                        have[1].append(rows[:take])
                        of, ids, rows = (rows.shape[1], deal), ids[take:], rows[take:]
                        if sum(map(len, have[0])) == size:
                            yield packed(*of, *held.pop(of), part)
                            part += 1
        for of, have in held.items():
            yield packed(*of, *have, part)
            part += 1

    out = df.select("vec_id", "embedding", "deal").mapInArrow(run, "side int, length int, deal int, ids binary, raw binary, part long")
    return out.withColumn("tile", F.explode(tile)).select("tile", "side", "length", "ids", "raw")


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of the largest cosine for each row of queries; both: vec_id and embedding."""
    kind = vectors.kind_of(candidates, queries)
    letter, least = NUMBERS[kind], int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = vectors.id_and_vector(queries, kind).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).distinct()
    entries = asked.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    groups = max(1, -(-entries * np.dtype(letter).itemsize // GROUP_BYTES))
    strips = max(1, min(-(-least // groups), max(FEW_STRIPS, -(-(common.plan_bytes(candidates) or 2**60) // STRIP_BYTES))))

    dealt = asked.withColumn("deal", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)).cast("int"))
    every_strip = F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda s: F.col("deal") * strips + s)
    every_group = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * strips + F.pmod("part", F.lit(strips)).cast("int"))
    sides = blocks(dealt.repartition(groups, "deal"), 0, kind, every_strip), blocks(vectors.id_and_vector(candidates, kind).withColumn("deal", F.lit(0)), 1, kind, every_group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked_here, meeting = None, {}, {}
        for batch in batches:
            for here, side, length, ids, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:]):
                ids = np.frombuffer(ids.as_py(), np.int64)
                rows = np.frombuffer(raw.as_py(), letter).reshape(len(ids), length)
                if here != tile:
                    yield from (g.found() for g in meeting.values())
                    tile, asked_here, meeting = here, {}, {}
                if side == 0:
                    asked_here.setdefault(length, []).append((ids, rows))
                    continue
                if length in asked_here:
                    meeting[length] = Group(*(np.concatenate(part) for part in zip(*asked_here.pop(length))), k)
                if length in meeting:
                    meeting[length].meet(Block(ids, rows, k))
        yield from (g.found() for g in meeting.values())

    tiles = sides[0].unionByName(sides[1]).repartitionById(groups * strips, "tile").sortWithinPartitions("tile", "side")
    heaps = tiles.mapInArrow(run, "query_id long, query_key long, vec_id long, vec_key long, score double")
    one = F.struct((-F.col("score")).alias("far"), F.col("vec_id").isNull().alias("nameless"), "vec_id", "vec_key", "score")
    best = heaps.groupBy("query_id", "query_key").agg(F.slice(F.array_sort(F.collect_set(one)), 1, k).alias("best"))
    of = best.select("query_id", F.posexplode("best").alias("place", "b"))
    return of.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
