"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockjoin, bpe, centroids, common, digest, langid, matroska, mixing, pii, sharding, simhash, substring, tokenfile, vectors, whitening

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
SHARDS = 24


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def line_of(spans: Column | str) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = pii.find(docs, pii.fit(docs))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line_of("base"), 256).alias("base_sha256"), line_of("spans").alias("spans"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_code("fp").alias("fingerprint"), "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(common.documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    prints = common.cut(digest.with_next(docs))
    groups = digest.same_documents(docs, prints.select("doc_id", "fingerprint"))
    whole = groups.where("doc_id IS NULL").select("fingerprint", F.col("first_id").alias("first_of_bucket"))
    apart = groups.where("doc_id IS NOT NULL").select("doc_id", F.col("first_id").alias("first_of_text")).distinct()
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return (
        prints.join(whole, "fingerprint", "left")
        .join(apart, "doc_id", "left")
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"), F.coalesce("first_of_text", "first_of_bucket", "doc_id").alias("same_as"))
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(common.documents(spark, sf_dir), tree := sharding.Tree.even(SHARDS), tree.grown())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: Region by region, then rack by rack in the chosen region, then shard by shard in the chosen rack.
OP6_SQL = """
WITH leaf AS (
  SELECT s AS shard, CAST(s // 8 AS VARCHAR) AS region, CAST(s // 8 AS VARCHAR) || '/' || CAST(s // 4 AS VARCHAR) AS rack,
    CAST(s // 8 AS VARCHAR) || '/' || CAST(s // 4 AS VARCHAR) || '/' || CAST(s % 4 AS VARCHAR) AS path FROM range(25) t(s)
), tree AS (
  SELECT grown, shard, region, rack, path FROM leaf, (VALUES (false), (true)) g(grown) WHERE grown OR shard < 24
), d AS (
  SELECT doc_id, grown, shard, region, rack, path,
    -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/' || region), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / count(*) OVER (PARTITION BY doc_id, grown, region) AS of_region,
    -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/' || rack), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / count(*) OVER (PARTITION BY doc_id, grown, rack) AS of_rack,
    -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/' || path), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS of_shard
  FROM documents, tree
), in_region AS (
  SELECT * FROM d QUALIFY region = arg_min(region, of_region) OVER (PARTITION BY doc_id, grown)
), in_rack AS (
  SELECT * FROM in_region QUALIFY rack = arg_min(rack, of_rack) OVER (PARTITION BY doc_id, grown)
), chosen AS (
  SELECT doc_id, grown, arg_min(shard, of_shard) AS shard FROM in_rack GROUP BY 1, 2
)
SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) + 8 AS BIGINT) AS size, CAST(a.shard AS INTEGER) AS shard, CAST(b.shard AS INTEGER) AS grown_shard
FROM documents d JOIN chosen a ON a.doc_id = d.doc_id AND NOT a.grown JOIN chosen b ON b.doc_id = d.doc_id AND b.grown
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.scratch_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokenfile.write_files(tokenfile.encode_files(common.documents(spark, sf_dir), tokenizer_path(BYTE_BPE)), folder)
    return tokenfile.decode_files(tokenfile.read_files(spark, folder))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.described(matroska.stored(common.documents(spark, sf_dir)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vectors.embeddings(spark, sf_dir)
    white = whitening.whiten(table, whitening.fit(table))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vectors.embeddings(spark, sf_dir)
    return centroids.assign(table, *centroids.fit(table))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vectors.embeddings(spark, sf_dir)
    return blockjoin.search(table, table.where(F.col("vec_id") % blockjoin.EVERY == 0))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), spots AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS k FROM spots
), earliest AS (
  SELECT k, min(doc_id) AS least FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM win JOIN earliest USING (k), range(13) t(o) WHERE least < doc_id
), word AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w
), stays AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN stays USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM per
), total AS (
  SELECT CAST(sum(source_size) AS BIGINT) * 3 AS twice FROM weighed
), shared AS (
  SELECT 0 AS round, source, source_size, cap, weight, false AS capped FROM weighed
  UNION ALL
  SELECT round + 1, source, source_size, cap, weight, capped OR weight * (twice - 2 * coalesce(sum(cap) FILTER (capped) OVER (), 0)) > 2 * cap * sum(weight) FILTER (NOT capped) OVER ()
  FROM shared, total WHERE round < (SELECT count(*) FROM weighed)
), last AS (
  SELECT * FROM shared WHERE round = (SELECT count(*) FROM weighed)
), target AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (twice - 2 * coalesce(sum(cap) FILTER (capped) OVER (), 0)) AS DOUBLE) / CAST(2 * sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM last, total
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate FROM target
)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""



def op12_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """One step a round: each vector's nearest centroid, then the floors of the means."""
    number = "CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, [{number} for v in embedding] AS x FROM embeddings WHERE len(embedding) = 64 AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, x AS c FROM (SELECT x, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h LIMIT {k}))",
    ]
    far = "list_sum([(t[1] - t[2]) * (t[1] - t[2]) for t in list_zip(x, c)])"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, CAST(arg_min(k, d * {k} + k) AS INTEGER) AS k, min(d) AS d FROM (SELECT vec_id, x, k, CAST({far} AS BIGINT) AS d FROM kept, c{r}) GROUP BY vec_id)")
        if r < rounds:
            sums = f"SELECT k, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS p, unnest(x) AS v FROM a{r}) GROUP BY k, p"
            steps.append(f"m{r} AS MATERIALIZED (SELECT k, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY p) AS c FROM ({sums}) GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.k = o.k)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


OP13_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(c AS DOUBLE) for c in embedding] AS x FROM embeddings WHERE len(embedding) > 0 AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), n AS (
  SELECT vec_id, x, sqrt(list_sum([c * c for c in x])) AS size FROM v WHERE len([c for c in x if c <> 0]) > 0
), pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([t[1] * t[2] for t in list_zip(q.x, c.x)]) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
)
SELECT query_id, CAST(row_number() OVER near AS INTEGER) AS rank, vec_id, score FROM pair WINDOW near AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER near <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_skip_chain": op1,
    "op2_simhash_gray_index": op2,
    "op3_substring_recompression": op3,
    "op4_bpe_pair_index": op4,
    "op5_canonical_digest": op5,
    "op6_hash_tree_sharding": op6,
    "op7_rans_token_files": op7,
    "op8_langid_centroids": op8,
    "op9_matroska_media": op9,
    "op10_mix_repetition_rates": op10,
    "op11_whiten_welford_qr": op11,
    "op12_centroids_gemm": op12,
    "op13_block_matrix_neighbours": op13,
}
#: op6: text_crc32 has no SQL function there, so its SQL is used by the tests only.
ORACLE_SQL: dict[str, str] = {"op3_substring_recompression": OP3_SQL, "op10_mix_repetition_rates": OP10_SQL, "op12_centroids_gemm": op12_sql(), "op13_block_matrix_neighbours": OP13_SQL}
