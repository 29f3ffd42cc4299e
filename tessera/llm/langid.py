"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character bigrams and trigrams.  For each language the
vectors of a bounded, hash-chosen sample are clustered (spherical k-means) into a few centroids; a text
gets the language of the centroid with the highest cosine, and is rejected where that cosine is below
`reject_ratio` times what all but 1 % of the language's sample rows reach, measured on rows left out of
the clusters; the floor falls with the root of the length for texts of under 100 letters.

Fitting reads at most `max_sample` labelled rows (documented bound; the vectors of these rows, not
their texts, go to the driver).  Prediction is one narrow pass over all rows and whole texts.

Defined results
    null text or a text without a letter   language `und`, score 0, rejected; marks alone are no letters
    letters but no known n-gram            the first language, score 0, rejected
    no labelled row to learn from          `und`, score 0, rejected
    null doc_id                            never learned from; held out
    repeated rows                          each gets its own, equal result; learned from once
    empty table                            empty result
    extra columns                          ignored by `predict`, passed through by `keep_identified`
Memory in a worker grows with the longest text (about 60 bytes a character).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

UNKNOWN = "und"
BUCKETS = 1 << 18
#: A text of fewer letters can meet few of a centroid's n-grams, so its floor falls with the root of its length.
SHORT = 100
BLOCK_CHARS, BLOCK_DOCS = 600_000, 256

_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Centroids:
    """A fitted model: a few megabytes at most, whatever the corpus."""

    languages: tuple[str, ...]
    vocabulary: np.ndarray  # hash buckets, ascending
    idf: np.ndarray
    vectors: np.ndarray  # one unit row a centroid
    owner: np.ndarray  # the language of each centroid
    floor: np.ndarray  # of each language; lesser cosines are rejected


def letters() -> np.ndarray:
    """1 for the code points of letters, 2 for those of marks, which belong to the letter before them; built once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter(("LM".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)), np.uint8, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash bucket) of every n-gram, and how many letters each text has.

    Every letter or mark gives the trigram around it, with a blank for what is neither, and the bigram with
    the one after it.  A text of marks alone has no letter.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer("  ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 2 for t in low])
    doc = np.concatenate([np.zeros(2, np.int32), doc])[: len(code)]
    kind = letters()[code]
    is_letter = kind > 0
    a = np.where(is_letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    tri = (a[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[at + 1] * np.uint64(0x165667B19E3779F9))
    both = at[is_letter[at + 1]]
    two = (a[both] * np.uint64(0xD6E8FEB86659FD93)) ^ (a[both + 1] * np.uint64(0xA0761D6478BD642F))
    hashed = np.concatenate([tri, two])
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    has = np.bincount(doc[kind == 1], minlength=len(low))
    return np.concatenate([doc[at], doc[both]]), (hashed >> np.uint64(46)).astype(np.int32), has


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts that are counted together, with the index of their first."""
    first, held, chars = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        chars += len(held[-1])
        if chars >= BLOCK_CHARS or len(held) >= BLOCK_DOCS:
            yield first, held
            first, held, chars = i + 1, [], 0
    if held:
        yield first, held


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the doc_id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def sample_vectors(df: DataFrame, max_sample: int) -> list:
    """(lang, buckets, counts) of at most max_sample labelled rows, as many of each language as fit.

    Rows are taken by the hash of their id and text.  A first pass counts the languages; the rows whose hash lies under
    twice the share that is wanted of their language are few, and only these are ranked.  Equal rows count as one.  Of
    more languages than fit the most frequent are learned.  Then the texts of the chosen rows are counted where they lie.
    """
    learn = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(~held_out() & F.col("lang").isNotNull())
    learn = learn.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    per = counts.orderBy(F.col("n").desc(), "lang").limit(max_sample).toArrow().to_pydict()
    each = max(1, max_sample // max(1, len(per["lang"])))
    share = learn.sparkSession.createDataFrame([(lang, 2.0 * each / n) for lang, n in zip(per["lang"], per["n"], strict=True)], "lang string, share double")
    few = learn.select("doc_id", "lang", "h").join(F.broadcast(share), "lang").where(F.col("share") * 2.0**63 >= F.abs("h")).select("doc_id", "lang", "h").distinct()
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    keys = few.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= each).select("doc_id", "lang", "h")
    chosen = learn.join(F.broadcast(keys), ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"])

    def count(batches):
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "lang": [], "buckets": [], "counts": []}
            ids, langs, texts = (batch.column(n).to_pylist() for n in ("doc_id", "lang", "text"))
            for first, some in blocks(texts):
                doc, bucket, has = grams(some)
                for k in np.flatnonzero(has):
                    b, c = np.unique(bucket[doc == k], return_counts=True)
                    for name, v in zip(out, (ids[first + k], langs[first + k], b.astype(np.int32), c.astype(np.int32)), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["lang"], pa.string()), pa.array(out["buckets"], pa.list_(pa.int32())), pa.array(out["counts"], pa.list_(pa.int32()))], names=list(out))

    rows = chosen.select("doc_id", "lang", "text").mapInArrow(common.lean(count), "doc_id long, lang string, buckets array<int>, counts array<int>").toArrow().to_pydict()
    order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i], rows["lang"][i], rows["buckets"][i], rows["counts"][i]))
    return [(rows["lang"][i], np.array(rows["buckets"][i], np.int32), np.array(rows["counts"][i], np.int32)) for i in order]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of unit rows; starts from the row nearest the mean, then the farthest ones."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(df: DataFrame, max_sample: int = 2000, per_language: int = 3, grams_per_language: int = 1500, max_grams: int = 6000, reject_ratio: float = 0.5) -> Centroids:
    """Learn from doc_id, lang and text of rows that are not held out."""
    rows = sample_vectors(df, max_sample)
    languages = tuple(sorted({r[0] for r in rows}))
    nothing = np.zeros((0, 0), np.float32)
    if not rows:
        return Centroids((), np.zeros(0, np.int32), np.zeros(0, np.float32), nothing, np.zeros(0, np.int32), np.zeros(0))
    df_all = np.zeros(BUCKETS, np.int32)
    chosen: set[int] = set()
    for lang in languages:
        own = np.zeros(BUCKETS, np.int32)
        for _, b, _ in (r for r in rows if r[0] == lang):
            own[b] += 1
        df_all += own
        chosen.update(np.argsort(-own, kind="stable")[: min(grams_per_language, max_grams // len(languages), int((own > 0).sum()))].tolist())
    vocabulary = np.array(sorted(chosen), np.int32)
    idf = (np.log((1 + len(rows)) / (1 + df_all[vocabulary])) + 1).astype(np.float32)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (_, b, c) in enumerate(rows):
        at = np.searchsorted(vocabulary, b)
        ok = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == b)
        x[i, at[ok]] = np.log1p(c[ok])
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.maximum(norm, 1e-12)
    labels = np.array([languages.index(r[0]) for r in rows])
    # every fifth row of a language is left out of its clusters and tells how near its texts come to them
    nth = np.zeros(len(rows), np.int64)
    for k in range(len(languages)):
        nth[labels == k] = np.arange((labels == k).sum())
    apart = nth % 5 == 4
    parts = [spherical_kmeans(x[(labels == k) & ~apart], per_language) for k in range(len(languages))]
    floors = []
    for k, centres in enumerate(parts):
        asked = (labels == k) & (norm[:, 0] > 0)
        near = (x[asked & apart if (asked & apart).any() else asked] @ centres.T).max(axis=1)
        floors.append(reject_ratio * float(np.quantile(near, 0.01)) if len(near) else 0.0)
    return Centroids(languages, vocabulary, idf, np.concatenate(parts), np.repeat(np.arange(len(languages)), [len(p) for p in parts]), np.array(floors))


def scores(texts: list[str | None], model: Centroids) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine of the nearest centroid and whether it is rejected, of each text."""
    names, best, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if not model.languages:
        return names, best, rejected
    known = np.full(BUCKETS, -1, np.int32)
    known[model.vocabulary] = np.arange(len(model.vocabulary), dtype=np.int32)
    v = len(model.vocabulary)
    for first, some in blocks(texts):
        doc, bucket, has = grams(some)
        at = known[bucket]
        ok = at >= 0
        x = np.log1p(np.bincount(doc[ok].astype(np.int64) * v + at[ok], minlength=len(some) * v).reshape(len(some), v)).astype(np.float32) * model.idf
        norm = np.linalg.norm(x, axis=1)
        cosine = (x @ model.vectors.T) / np.maximum(norm, 1e-12)[:, None]
        top = cosine.argmax(axis=1)
        for k in np.flatnonzero(has):
            i = first + int(k)
            names[i] = model.languages[model.owner[top[k]]]
            best[i] = round(min(1.0, max(0.0, float(cosine[k, top[k]]))), 6)
            rejected[i] = norm[k] == 0 or best[i] < model.floor[model.owner[top[k]]] * min(1.0, (has[k] / SHORT) ** 0.5)
    return names, best, rejected


def predict(df: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; only the text is used to predict."""

    def run(batches):
        for batch in batches:
            names, best, rejected = scores(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    asked = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(common.lean(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Centroids) -> DataFrame:
    """The rows that are not rejected, with all their columns, in one narrow pass."""

    text = df.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~scores(batch.column(text).to_pylist(), model)[2]))

    return common.map_by_place(df, run)
