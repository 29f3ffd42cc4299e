"""Near copies by word shingles: SimHash links first, an exact join on Jaccard similarity for what they miss, one row kept of each group.

A text is lower-cased (A-Z only) and cut into words; its set holds 64-bit hashes of its shingles of five words.
Two texts are near copies if 9 |A and B| >= 4 (|A| + |B|), which is a similarity of 0.8 or more.

0. SimHash.  Fingerprints of the sets go through the Gray-order index of the SimHash operator, whose links are
   candidates like those below.  At a similarity of 0.8 fingerprints differ in about ten bits, where no index of
   64 bits can prune, so the steps below find the rest exactly.

1. Order.  All sets are sorted by one order of shingles, the rare ones first, by counts in a bounded table of hashed
   counters; the order decides the cost only, since any order that all rows share gives the same pairs.
2. Prefixes.  A set shares at least 0.8 of its size with a near copy, so the two share a shingle among the first
   |A| // 5 + 1 of each.  Rows meet by these.  What two sets share lies from their first shared shingle on, so a pair is
   left where it meets too late for that shingle: if similar it meets at an earlier one.  With equal sizes that is past
   a ninth of the set, so a passage that unlike texts share is seldom sent.
3. Checks.  First all that meet are paired with the least of them; then, `TURNS` times, each with one other that no
   component joins it with, another one each time; then all pairs that are still apart, so that no link is lost.
   The first rounds send as many pairs as rows meet, and leave few to the last.  Parity marks where rows meet drop pairs
   before they are sent, and longer parity sketches drop more that
   cannot be similar; every other pair is checked on the whole sets.  No group is capped, and copies of a set count once.
4. Groups.  Components are closed over the checked pairs only.

Sets are named by 64-bit digests, so equal sets are one node without a check.

Defined results
    null or empty text, or only white space   the empty set; all such rows are copies of one another
    fewer than five words                     the whole word sequence is the one shingle
    null doc_id                               the row stays; it links others like any row
    repeated rows                             copies
    empty table                               empty result
    extra columns                             passed through
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import common, simhash
from .bpe import runs
from .substring import BASES, Words, mix

SHINGLE = 5
#: Odd multipliers, one for each word of a shingle.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
COUNTER_BITS = 22
COUNTERS = 1 << COUNTER_BITS
BLOCKS = 64  # of counters, in which tasks' counts are summed up
TURNS = 2
FILTER_BITS = 1 << 24
HELD = 1 << 20  # rows or pairs that are held before they are passed on
BUCKET = "key long, node long, size int, place int"


def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of each text, ascending."""
    for a, b in runs([len(t or "") for t in texts], 1 << 20):
        words = Words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[a:b]])
        of = words.hashes(BASES[0])[words.slot]
        most = max(0, len(of) - SHINGLE + 1)
        whole = mix(sum((of[k : most + k] * FACTORS[k] for k in range(SHINGLE)), np.zeros(most, np.uint64)))
        for first, count in zip(words.first.tolist(), words.count.tolist(), strict=True):
            if count >= SHINGLE:
                yield np.unique(whole[first : first + count - SHINGLE + 1])
            else:
                yield mix((of[first : first + count] * FACTORS[:count]).sum(keepdims=True) + np.uint64(count)) if count else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    return next(sets_of([text]))


def name_of(of: np.ndarray) -> int:
    """The digest of a set, as a signed number."""
    return simhash.signed(xxhash.xxh64_intdigest(of.tobytes(), 42))


def counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rarity(df: DataFrame) -> bytes:
    """For each counter how many shingles fell into it, as an eighth of a power of two in a byte; packed.

    Tasks send their counts by blocks, which are summed up side by side; the driver sees one byte a counter.
    """
    width = COUNTERS // BLOCKS

    def run(batches):
        counts, held, rows = np.zeros(COUNTERS, np.uint32), [], 0
        for batch in batches:
            for of in sets_of(batch.column("text").to_pylist()):
                held.append(counter(of))
                rows += len(of)
                if rows > HELD:
                    np.add.at(counts, np.concatenate(held), np.uint32(1))
                    held, rows = [], 0
        if held:
            np.add.at(counts, np.concatenate(held), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([pack(counts[k * width : (k + 1) * width].tobytes()) for k in range(BLOCKS)], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)
                sums[k] = sums.get(k, np.zeros(width, np.int64)) + part
        eighths = [np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(eighths, pa.binary())], names=["block", "counts"])

    sent = common.id_and_text(df).select("text").mapInArrow(common.lean(run), "block int, counts binary")
    found = sent.repartitionById(BLOCKS, F.col("block")).mapInArrow(common.lean(add), "block int, counts binary").toArrow().to_pydict()
    blocks = dict(zip(found["block"], found["counts"], strict=True))
    return zstandard.ZstdCompressor(level=3).compress(b"".join(blocks.get(k, bytes(width)) for k in range(BLOCKS)))


def prefixes(df: DataFrame, often: bytes) -> DataFrame:
    """key (a shingle of the prefix), node, size and the shingle's place in the set's order."""

    def run(batches):
        weight = np.frombuffer(zstandard.ZstdDecompressor().decompress(often), np.uint8)
        held, rows = [], 0

        def out():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "node", "size", "place"])

        for batch in batches:
            for of in sets_of(batch.column("text").to_pylist()):
                n = len(of) // 5 + 1 if len(of) else 0
                first = of[np.argsort(weight[counter(of)], kind="stable")[:n]].view(np.int64)
                held.append((first, np.full(n, name_of(of), np.int64), np.full(n, len(of), np.int32), np.arange(n, dtype=np.int32)))
                rows += n
                if rows > HELD:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return common.id_and_text(df).select("text").mapInArrow(common.lean(run), BUCKET)


def whole(batches, names: tuple[str, ...]) -> list[np.ndarray] | None:
    held = [[batch.column(n).to_numpy(zero_copy_only=False) for n in names] for batch in batches]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else None


def meetings(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of keys that several nodes have, each node once a key."""

    def run(batches):
        columns = whole(batches, ("key", "node", "size", "place"))
        if columns is not None:
            key, node = columns[:2]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
            order, key = order[once], key[once]
            same = key[1:] == key[:-1]
            order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], names=["key", "node", "size", "place"])

    return rows.repartition(parts, "key").mapInArrow(common.lean(run), BUCKET)


def possible(size: np.ndarray, place: np.ndarray, i, j) -> np.ndarray:
    """Whether i and j may be similar if this is the first shingle in the order that they share: what they share then lies from here on.

    At a later shared shingle the answer may be False for a similar pair, which its first one gives.
    """
    rest = np.minimum(size[i] - place[i], size[j] - place[j])
    return 9 * rest >= 4 * (size[i] + size[j])


def alike(size: np.ndarray, mark: np.ndarray, i, j) -> np.ndarray:
    """False only where the sets are not similar: each value that one set has alone changes at most one parity of its mark."""
    return 9 * np.bitwise_count(mark[i] ^ mark[j]).sum(axis=1, dtype=np.int64) <= size[i] + size[j]


def pairs_of(start: np.ndarray, label: np.ndarray | None, size: np.ndarray, place: np.ndarray, mark: np.ndarray | None = None, turn: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key: without labels, each with the first of its key; with a turn, each with one other whose label differs; else all
    others whose labels differ."""
    rows = len(size)
    stop = np.append(start[1:], rows)
    if label is None:
        i, j = np.repeat(start, stop - start), np.arange(rows)
        ok = (i != j) & possible(size, place, i, j)
        yield i[ok], j[ok]
        return
    mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
    start, stop = start[mixed], stop[mixed]
    if turn is not None:
        count = stop - start
        i = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first, n = np.repeat(start, count), np.repeat(count, count)
        j = first + (i - first + 1 + turn * 7919 % np.maximum(n - 1, 1)) % n
        ok = (label[i] != label[j]) & possible(size, place, i, j) & alike(size, mark, i, j)
        yield np.minimum(i, j)[ok], np.maximum(i, j)[ok]
        return
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        for i in range(s, e - 1):
            j = np.arange(i + 1, e)
            j = j[(label[j] != label[i]) & possible(size, place, i, j)]
            j = j[alike(size, mark, np.full(len(j), i), j)]
            if len(j):
                yield np.full(len(j), i), j


def candidates(met: DataFrame, parts: int, labelled: bool, turn: int | None = None) -> DataFrame:
    """u > v: nodes that may be near copies, of the pairs that pairs_of gives."""
    names = ("key", "node", "size", "place", *(["label", *MARKS] if labelled else []))

    def run(batches):
        columns = whole(batches, names)
        if columns is None or not len(columns[0]):
            return
        order = np.lexsort((columns[1], columns[0]))
        key, node, size, place, *rest = (c[order] for c in columns)
        label, mark = (rest[0], np.stack(rest[1:], axis=1).view(np.uint64)) if labelled else (None, None)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        held, rows = [], 0

        def out():
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            pair = np.unique(np.stack([node[v], node[u]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

        for i, j in pairs_of(start, label, size.astype(np.int64), place.astype(np.int64), mark, turn):
            held.append((i, j))
            rows += len(i)
            if rows > HELD:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return met.repartition(parts, "key").select(*names).mapInArrow(common.lean(run), "u long, v long").distinct()


MARKS = ("m0", "m1", "m2", "m3")


def mark_of(of: np.ndarray) -> np.ndarray:
    """The parity of the set's values in each of 256 places, as four signed numbers."""
    return np.packbits((np.bincount((of & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def sketch(of: np.ndarray) -> bytes:
    """The parity of the set's values in each of at least 2 |A| places, a power of two."""
    bits = 1 << max(6, (2 * len(of) - 1).bit_length() if len(of) else 0)
    return np.packbits((np.bincount((of & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def close(a: bytes, b: bytes, total: int) -> bool:
    """False only if the sets are not similar: each value that one set has alone changes at most one parity."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= total


def fingerprint(of: np.ndarray) -> int:
    """The SimHash of a set, as a signed number."""
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(of), 8192):
        set_in += np.unpackbits(of[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(of), bitorder="little").view(np.int64)[0])


def described(df: DataFrame) -> DataFrame:
    """node, least (the smallest doc_id, LAST_ID if none has one), size, fp, marks and sketch of each distinct set."""

    def run(batches):
        for batch in batches:
            sets = list(sets_of(batch.column("text").to_pylist()))
            columns = [pa.array([name_of(x) for x in sets], pa.int64()), batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())]
            marks = np.array([mark_of(x) for x in sets], np.int64).reshape(-1, len(MARKS))
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(marks[:, k])) for k in range(len(MARKS)))], names=["node", "doc_id", "size", "fp", "sketch", *MARKS])

    rows = common.id_and_text(df).mapInArrow(common.lean(run), "node long, doc_id long, size int, fp long, sketch binary, " + ", ".join(f"{m} long" for m in MARKS))
    return rows.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(simhash.LAST_ID))).alias("least"), *(F.first(c).alias(c) for c in ("size", "fp", "sketch", *MARKS)))


def linked(nodes: DataFrame, parts: int) -> DataFrame:
    """u > v: nodes of one fingerprint with the least of them, and the least ones of linked fingerprints."""
    heads = common.cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    alike = nodes.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    of = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    near = simhash.near_links(heads.select("fp"), parts=parts).withColumnsRenamed({"u": "a", "v": "b"}).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return alike.unionByName(near.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that their sketches do not rule out."""

    def run(batches):
        for batch in batches:
            a, b, total = (batch.column(n).to_pylist() for n in ("a", "b", "total"))
            near = [close(x, y, n) for x, y, n in zip(a, b, total, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    of = lambda u, a, n: nodes.select(F.col("node").alias(u), F.col("sketch").alias(a), F.col("size").alias(n))
    both = pairs.join(of("u", "a", "m"), "u").join(of("v", "b", "n"), "v")
    return both.select("u", "v", "a", "b", (F.col("m") + F.col("n")).alias("total")).mapInArrow(common.lean(run), "u long, v long")


def checked(df: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""
    pairs = common.cut(sketched(pairs, nodes))
    bits = pairs.select(F.explode(F.array("u", "v")).alias("n")).select(F.pmod("n", F.lit(FILTER_BITS)).alias("b"))
    words = bits.groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("m")).toArrow()
    wanted = np.zeros(FILTER_BITS // 64, np.int64)
    wanted[words["w"].to_numpy()] = words["m"].to_numpy()

    def run(batches):
        seen = set()
        for batch in batches:
            nodes, sets = [], []
            for of in sets_of(batch.column("text").to_pylist()):
                node = name_of(of)
                b = node % FILTER_BITS
                if int(wanted[b // 64]) >> b % 64 & 1 and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(of.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "of"])

    if not words.num_rows:
        return pairs
    sets = common.id_and_text(df).select("text").mapInArrow(common.lean(run), "node long, of array<long>").dropDuplicates(["node"])
    a, b = sets.select(F.col("node").alias("u"), F.col("of").alias("a")), sets.select(F.col("node").alias("v"), F.col("of").alias("b"))
    both = 9 * F.size(F.array_intersect("a", "b")).cast("long") >= 4 * (F.size("a") + F.size("b")).cast("long")
    return pairs.join(a, "u").join(b, "v").where(both).select("u", "v")


def groups(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of every set that has a near copy."""
    parts = common.partitions_for(df, 16 << 20)
    met = common.scratch_table(meetings(prefixes(df, rarity(df)), parts), "meetings")
    links = simhash.components(checked(df, nodes, linked(nodes, parts).unionByName(candidates(met, parts, False)).distinct()))
    for turn in (*range(TURNS), None):
        labels = met.join(links.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")).join(nodes.select("node", *MARKS), "node")
        more = checked(df, nodes, candidates(labels, parts, True, turn))
        links = simhash.components(links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return links


def with_node(df: DataFrame, text: str) -> DataFrame:
    """df, whose columns are named by place, with the digest of each row's set as node."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            nodes = [name_of(of) for of in sets_of(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "node"])

    return df.mapInArrow(common.lean(run), StructType(df.schema.fields[:]).add("node", LongType()))


def keep_first(df: DataFrame) -> DataFrame:
    """One row of each group, that of its smallest doc_id and then of its least set's digest, with all columns; rows without an id stay.

    Rows are told apart by id and set, so an id that stands on unlike texts keeps each of them that is the first of its group.  Columns
    go by place, so any names may clash.
    """
    last = F.lit(simhash.LAST_ID)
    with common.brief_shuffles(df.sparkSession):
        nodes = common.cut(described(df))
        links = groups(df, nodes)
    rooted = nodes.join(links, "node", "left").select("least", "node", F.coalesce("root", "node").alias("root"))
    keep = rooted.groupBy("root").agg(F.min(F.struct("least", "node")).alias("x")).where(F.col("x.least") < last).select(F.col("x.least").alias("kept_id"), F.col("x.node").alias("kept_node"))
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    doc_id, text = (f"c{df.columns.index(n)}" for n in ("doc_id", "text"))
    same = (F.col(doc_id).cast("long") == F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    named = with_node(plain.where(F.col(doc_id).isNotNull()), text).join(keep, same).dropDuplicates(["kept_id", "kept_node"]).select(*plain.columns)
    return named.unionByName(plain.where(F.col(doc_id).isNull())).toDF(*df.columns)
