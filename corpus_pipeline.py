"""A corpus pipeline of five stages, each one of the corpus operators in tessera.llm.

Every stage takes (spark, docs, sf_dir) and all the rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, common, langid, mixing, nearcopies, pii, queries


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter or far from all centroids go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.keep_first(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept once or left out so that sources reach their targets."""
    return mixing.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    return bpe.encode(docs, queries.tokenizer_path(queries.WORD_BPE))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("private_data", private_data), ("mix_sources", mix_sources), ("tokenize", tokenize)]

#: SQL has no centroid classifier or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written to the shared folder and read again by the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
