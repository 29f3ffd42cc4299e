"""SimHash near-duplicate groups through a Gray-order hierarchical index.

1. Fingerprints.  A text is lower-cased (A-Z only) and cut into words and word shingles; a fingerprint
   bit is set if it is set in over half of the shingles' XXH64 values (seed 42).
2. Routing.  Two fingerprints within `radius` = 2 bits agree on at least two of four 16-bit blocks, so each
   distinct fingerprint goes to six buckets by the value of two blocks.  A bucket that holds more than
   `hot` distinct fingerprints is split: its rest is cut in three, of which one must agree again, twice
   over.  After that at most 2**15 distinct fingerprints can share a bucket: no group is unbounded, and
   no pair within the radius is lost.
3. Index.  Inside a bucket fingerprints are sorted by Gray rank and grouped by eights, level by level.
   A node holds the bit pattern that all below it share, less what its parent holds already.  A search
   descends from the root, adds up the differing bits of each node's own pattern and drops the whole
   group once they pass the radius.
4. Groups.  A task emits a spanning forest of the links it found, not the links; components are closed
   over these edges by alternating large-star and small-star rounds on checkpointed tables, in which no
   task gets all edges of a node that has many.

Copies share a fingerprint and are never expanded into pairs.

Defined results
    null or empty text, or only white space   fingerprint zero, linked like any other
    fewer words than a shingle has            the whole word sequence is the one shingle
    null doc_id                               keeps its row; counts for a component only if no id does
    repeated rows                             equal rows out, one for each
    empty table                               empty result
    extra columns                             ignored
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 2
LAST_ID = 2**63 - 1  # stands for a missing doc_id, so that any other is smaller
FANOUT = 8
FRONTIER = 1_500_000  # pairs of a query and a node that are held at once
HUB_SHARE = 500  # a hub has more than this part of the edges, so there are few
HUB_LEAST = 100
TASK_EDGES = 1 << 19  # edges that meet in one task, about


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    take = min(shingle, len(words))
    stops = (ends[take - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, stops, strict=True)), np.uint64, len(stops))
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        set_in += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return common.id_and_text(df).mapInArrow(common.lean(run), "doc_id long, fp long")


# -- the index of one task's buckets ---------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A forest over buckets of fingerprints, one tree a bucket, built level by level with numpy.

    codes are sorted by bucket and Gray rank; bucket_start gives the first row of each bucket and ends with the row count.
    """

    def __init__(self, codes: np.ndarray, bucket_start: np.ndarray):
        self.codes = codes
        size = np.diff(bucket_start)
        levels = []
        first = np.repeat(bucket_start[:-1], size)
        offset = np.arange(len(codes)) - first
        group = np.arange(len(codes))
        start, end = group, group + 1
        pattern_and = pattern_or = codes
        levels.append([start, end, pattern_and, pattern_or, None])
        span = 1
        while len(size) and size.max() > span:
            span *= FANOUT
            below = levels[-1][0]  # first row of each node one level down
            heads = np.flatnonzero(offset[below] % span == 0)
            start = below[heads]
            end = np.append(start[1:], len(codes))
            levels.append([start, end, np.bitwise_and.reduceat(pattern_and, heads), np.bitwise_or.reduceat(pattern_or, heads), np.append(heads, len(below))])
            pattern_and, pattern_or = levels[-1][2], levels[-1][3]
        self.levels = []
        above = None  # shared mask of the level above and the parent of each node
        for k in range(len(levels) - 1, -1, -1):
            start, end, all_set, any_set, children = levels[k]
            shared = ~(all_set ^ any_set)
            own = shared if above is None else shared & ~above[0][above[1]]
            self.levels.append((end, all_set, own, children))
            if children is not None:
                above = (shared, np.repeat(np.arange(len(start)), np.diff(children)))
        self.root = np.searchsorted(levels[-1][0], np.arange(len(codes)), side="right") - 1

    def near_pairs(self, radius: int):
        """Yields arrays (i, j), i < j, of rows in one bucket whose codes differ in at most radius bits."""
        rows = len(self.codes)
        bucket_rows = self.levels[0][0][self.root] - np.arange(rows)
        cost = np.cumsum(np.minimum(bucket_rows, 4 * FANOUT * FANOUT) + 1)
        begin = 0
        while begin < rows:
            stop = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + FRONTIER, side="right")))
            query = np.arange(begin, min(stop, rows))
            node, acc = self.root[query], np.zeros(len(query), np.int64)
            for depth, (end, value, own, children) in enumerate(self.levels):
                acc = acc + np.bitwise_count((self.codes[query] ^ value[node]) & own[node])
                keep = (acc <= radius) & (end[node] - 1 > query)  # rows up to the query itself pair with it elsewhere
                query, node, acc = query[keep], node[keep], acc[keep]
                if children is None:
                    yield query, node
                    break
                count = children[node + 1] - children[node]
                into = np.repeat(children[node] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(node) else node
                query, acc, node = np.repeat(query, count), np.repeat(acc, count), into
            begin = stop


def forest(rows: int, pairs) -> np.ndarray:
    """For each row the least row that it reaches over the pairs."""
    label = np.arange(rows)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def links_of_task(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges between the fingerprints of one task's buckets, as two arrays of unsigned codes."""
    order = np.lexsort((gray_rank(fp), value, mask))
    mask, value, fp = mask[order], value[order], fp[order]
    same = (mask[1:] == mask[:-1]) & (value[1:] == value[:-1])
    once = np.concatenate([[True], ~(same & (fp[1:] == fp[:-1]))])[: len(fp)]  # two ways of splitting can meet in one bucket
    new = np.concatenate([[True], ~same])[: len(fp)]
    fp, new = fp[once], np.flatnonzero(new[once])
    size = np.diff(np.append(new, len(fp)))
    fp, size = fp[np.repeat(size > 1, size)], size[size > 1]
    if not len(fp):
        return fp, fp
    label = forest(len(fp), GrayIndex(fp, np.concatenate([[0], np.cumsum(size)])).near_pairs(RADIUS))
    linked = label != np.arange(len(fp))
    return fp[linked], fp[label[linked]]


# -- routing, links and components -----------------------------------------------------------------


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def routes() -> dict[int, list[int]]:
    """Masks of the routing levels: 0 gives the first six, any mask gives the three that refine it."""
    out = {0: [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a, b in combinations(range(4), 2)]}
    for depth in range(2):
        for mask in out[0] if depth == 0 else [m for k in out[0] for m in out[k]]:
            rest = [b for b in range(64) if not mask >> b & 1]
            cuts = [len(rest) * k // 3 for k in range(4)]
            out[mask] = [mask | sum(1 << b for b in rest[cuts[k] : cuts[k + 1]]) for k in range(3)]
    return out


def routed(df: DataFrame, masks) -> DataFrame:
    """fp, mask, value: a row for each mask of the array column or list."""
    return df.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def buckets(codes: DataFrame, hot: int) -> DataFrame:
    """Each distinct fingerprint once a bucket; buckets of over `hot` rows are split, twice at most."""
    table = routes()
    level = routed(codes, F.array(*[F.lit(signed(m)) for m in table[0]]))
    done = None
    for masks in (table[0], [m for k in table[0] for m in table[k]]):
        large = level.groupBy("mask", "value").count().where(F.col("count") > hot).select("mask", "value")
        refine = F.element_at(F.create_map(*[x for m in masks for x in (F.lit(signed(m)), F.array(*[F.lit(signed(r)) for r in table[m]]))]), F.col("mask"))
        cold = level.join(large, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        done = cold if done is None else done.unionByName(cold)
        level = routed(level.join(large, ["mask", "value"], "left_semi").select("fp", refine.alias("masks")), F.col("masks"))
    return done.unionByName(level)


def near_links(codes: DataFrame, hot: int = 4096, parts: int | None = None) -> DataFrame:
    """Edges u > v (signed codes) that connect all fingerprints within the radius of one another."""

    def run(batches):
        held = [[batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("mask", "value", "fp")] for batch in batches]
        if held:
            a, b = (x.view(np.int64) for x in links_of_task(*(np.concatenate(x) for x in zip(*held, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    parts = parts or common.partitions_for(codes, 4 << 20)
    return buckets(codes, hot).repartition(parts, "mask", "value").mapInArrow(common.lean(run), "u long, v long").distinct()


def joined(a: np.ndarray, b: np.ndarray, moved: bool) -> pa.RecordBatch | None:
    """u, v, moved: each node of the edges (a > b) with the least one that it reaches over them; moved if that differs from an edge, or was given."""
    if not len(a):
        return None
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = forest(len(nodes), [(i, j)])
    moved = moved or bool((label[i] != j).any())
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]]), pa.array(np.full(len(other), moved))], names=["u", "v", "moved"])


def held_rows(batches, names: tuple[str, ...]) -> list[np.ndarray]:
    held = [[batch.column(n).to_numpy(zero_copy_only=False) for n in names] for batch in batches]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * len(names)


def deal_ends(hub: np.ndarray, least: np.ndarray):
    """key, other, done: each edge for both ends (0), but an edge to a hub as the large-star leaves it (1, or 2 if it moved)."""

    def of_hub(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(hub, x), max(0, len(hub) - 1))
        return (hub[at] == x, least[at]) if len(hub) else (np.zeros(len(x), bool), x)

    def run(batches):
        for batch in batches:
            u, v = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("u", "v"))
            low, to = of_hub(v)
            up = ~of_hub(u)[0]  # of a hub all know the least neighbour
            key = np.concatenate([u[up], v[~low], u[low]])
            other = np.concatenate([v[up], u[~low], to[low]])
            done = np.zeros(len(key), np.int8)
            done[len(key) - len(u[low]) :] = 1 + (to[low] != v[low])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(other), pa.array(done)], names=["key", "other", "done"])

    return run


def large_star(batches):
    """Each larger neighbour of a node with the node's least neighbour."""
    key, other, done = held_rows(batches, ("key", "other", "done"))
    a, b, moved = key[done > 0], other[done > 0], bool((done == 2).any())
    key, other = key[done == 0], other[done == 0]
    if len(key):
        nodes, at = np.unique(key, return_inverse=True)
        least = nodes.copy()
        np.minimum.at(least, at, other)
        up = other > key
        moved = moved or bool((least[at[up]] != key[up]).any())
        a, b = np.concatenate([a, other[up]]), np.concatenate([b, least[at[up]]])
    out = joined(a, b, moved)
    if out:
        yield out


def small_star(batches):
    u, v, moved = held_rows(batches, ("u", "v", "moved"))
    out = joined(u, v, bool(moved.any()))
    if out:
        yield out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the edges (u > v) reaches; each node once, without the roots.

    Alternates large-star (each larger neighbour of a node goes to the node's least one) and small-star (the smaller neighbours
    of a node and the node go to the least of them) until no edge moves; then every edge leads from a node to its root.  A task
    joins all edges that it is about to send, so that a node has at most one smaller neighbour from each task.  A hub's edges are
    not dealt to one task: the nodes with over one in HUB_SHARE of the edges are few, so the driver tells all tasks the least
    neighbour of each.  Edges never grow in number.  Each round is a checkpoint; the driver sees the hubs and whether an edge moved.
    """
    edges = common.cut(edges.select("u", "v"))
    count = edges.count()
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_EDGES))
    often = max(HUB_LEAST, count // HUB_SHARE)
    edges = edges.withColumn("moved", F.lit(True))
    while count:
        end = lambda k, m: F.struct(k.cast("long").alias("k"), m.cast("long").alias("m"))
        null, u, v = F.lit(None), F.col("u"), F.col("v")
        ends = edges.select(F.explode(F.when(F.col("moved"), F.array(end(v, null), end(u, v), end(null, null))).otherwise(F.array(end(v, null), end(u, v)))).alias("e"))
        found = ends.groupBy("e.k").agg(F.count(F.lit(1)).alias("n"), F.min("e.m").alias("m")).where((F.col("n") > often) | F.col("k").isNull()).select("k", F.least("k", "m").alias("m")).toArrow().to_pylist()
        hubs = sorted((x["k"], x["m"]) for x in found if x["k"] is not None)
        if len(hubs) == len(found):
            break
        hub, least = np.array(hubs, np.int64).reshape(-1, 2).T.copy()
        dealt = edges.mapInArrow(common.lean(deal_ends(hub, least)), "key long, other long, done byte").repartition(parts, "key")
        large = dealt.mapInArrow(common.lean(large_star), "u long, v long, moved boolean").repartition(parts, "u")
        edges = common.cut(large.mapInArrow(common.lean(small_star), "u long, v long, moved boolean"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, shingle: int = 3, hot: int = 4096) -> DataFrame:
    """doc_id, fp (signed), component_id (the smallest doc_id reachable) of every row."""
    docs = common.cut(fingerprints(df, shingle))
    codes = common.cut(docs.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("least")))
    roots = components(near_links(codes.select("fp"), hot))
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", F.when(F.col("component_id") < LAST_ID, F.col("component_id")).alias("component_id"))
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_code(column: str) -> Column:
    """A signed code as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
