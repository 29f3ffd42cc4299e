"""Canonical exact digests of documents.

A text is brought to NFKC, case-folded, brought to NFKC again, and its white space is folded (trimmed, runs
to one blank); the digest is the 128-bit XXH3 of the UTF-8 result.  `same_documents` groups rows by digest
and compares the canonical bytes with those of the first row of the bucket, so that a collision of
digests never joins two different texts.

`with_next` also pairs each document with the one after it in ascending doc_id.  Documents go once, as
compressed bytes, to ranges of doc_id; the first document of a range goes to the range before too, so
each range finds its last row's successor without a second pass.

Defined results
    null text        as the empty text
    null doc_id      before all ids; such rows come in the order of their digests
    repeated rows    next to each other, in the order of their digests
    one row only     is its own successor
    empty table      empty result
    extra columns    ignored
Memory in a worker: the texts of one range (about `RANGE_BYTES` of input).
"""

from __future__ import annotations

import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RANGE_BYTES = 32 << 20
#: Buckets of several rows whose digests are broadcast to find their rows again; beyond it they are joined.
BROADCAST_ROWS = 200_000


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by as many first ones of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def digests(df: DataFrame) -> DataFrame:
    """doc_id and fingerprint (32 hex digits) of every row."""

    def run(batches):
        for batch in batches:
            found = [digest(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return common.id_and_text(df).mapInArrow(common.lean(run), "doc_id long, fingerprint string")


def with_next(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint and next_fingerprint of every row."""
    docs = common.id_and_text(df)
    parts = common.partitions_for(df, RANGE_BYTES)
    splits, least = common.range_splits(docs, parts)
    last = len(splits)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = [common.NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            place = np.searchsorted(np.array(splits, np.int64), np.array(ids, np.int64), side="right").tolist()
            rows = [(p, 0, i, k) for k, (p, i) in enumerate(zip(place, ids, strict=True))]
            heads = set(splits)
            rows += [(place[k] - 1 if i in heads else last, 1, i, k) for k, i in enumerate(ids) if i in heads or i == least]
            prints = {k: digest(texts[k]) for k in range(len(texts))}
            packed = [pack(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([prints[r[3]] for r in rows], pa.string()), pa.array([packed[r[3]] for r in rows], pa.binary())],
                names=["place", "ahead", "doc_id", "fingerprint", "packed"],
            )

    def pair(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "next_fingerprint")}

        def emit(one, two):
            changed = edited(one[4], two[4])
            made = (None if one[2] == common.NO_ID else one[2], len(one[4]), one[3], sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(changed), two[3])
            for name, v in zip(out, made, strict=True):
                out[name].append(v)

        def flush():
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
            for v in out.values():
                v.clear()
            return made

        before = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("place", "ahead", "doc_id", "fingerprint")]
            for k, row in enumerate(zip(*columns, strict=True)):
                if before is not None and row[0] != before[0]:
                    before = None  # that was the successor of the range before, or a further copy of it
                if before is not None and before[1]:
                    continue
                row = (*row, unpack(batch.column("packed")[k].as_py()).decode("utf-8", "surrogatepass"))
                if before is not None:
                    emit(before, row)
                before = row
            yield flush()

    dealt = docs.mapInArrow(common.lean(deal), "place int, ahead int, doc_id long, fingerprint string, packed binary")
    return (
        dealt.repartitionById(last + 1, F.col("place"))
        .sortWithinPartitions("place", "ahead", "doc_id", "fingerprint")
        .mapInArrow(common.lean(pair), "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, next_fingerprint string")
    )


def same_documents(df: DataFrame, prints: DataFrame) -> DataFrame:
    """fingerprint and first_id of each bucket of several rows whose canonical bytes are all equal,
    and doc_id, fingerprint, first_id of the rows in the others (collisions of digests).

    Returned as one table: doc_id is null where the row speaks for its whole bucket.  prints: doc_id and
    fingerprint of df's rows, from a checkpoint.  Only rows in buckets of several are read again.  They
    are grouped by digest and bytes, pre-aggregated before the shuffle, so a bucket that holds a third of
    all rows sends one row a task.
    """
    shared = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def canon(batches):
        for batch in batches:
            made = [canonical(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_hexdigest(b) for b in made], pa.string()), pa.array(made, pa.binary())], names=["doc_id", "fingerprint", "bytes"])

    rows = common.id_and_text(df).mapInArrow(common.lean(canon), "doc_id long, fingerprint string, bytes binary")
    again = rows.join(F.broadcast(shared) if few else shared, "fingerprint")
    texts = again.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("first_id"))
    per = common.cut(texts.groupBy("fingerprint").agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("texts")))
    whole = per.where("texts = 1").select(F.lit(None).cast("long").alias("doc_id"), "fingerprint", "first_id")
    mixed = per.where("texts > 1").select("fingerprint")
    if mixed.isEmpty():
        return whole
    apart = again.join(mixed, "fingerprint")
    first = texts.join(mixed, "fingerprint").withColumnRenamed("first_id", "first_of_text")
    return whole.unionByName(apart.join(first, ["fingerprint", "bytes"]).select("doc_id", "fingerprint", F.col("first_of_text").alias("first_id")))
