"""Small documents tables with the awkward cases that every operator must stand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
SAMPLE = "/root/testdata/sf0.001/documents.parquet"


def documents(spark: SparkSession, rows: list[tuple], extra: str = "") -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA + extra)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 997} and" for k in range(30_000))
    texts = [None, "", " \n\t ", "one", "Zwei Wörter", "the cat sat on the mat " * 4, "the cat sat on the mat " * 4, long, long + " end", "a a a a a a a a a a a a a a a a a a a a", "mail me at jo.doe@example.com or +1 (017) 555-7713", "日本語のテキスト ß ﬁ <|endoftext|> Ünï x", "!!! ??? 123", "x" * 70_000]
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), 1, "x") for k, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, None, 2, "y"), (None, None, None, None, None, 3, None), rows[5], rows[5]]
    return documents(spark, rows, ", fingerprint int, shard string")


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])


def sample(spark: SparkSession) -> tuple[DataFrame, pd.DataFrame]:
    df = spark.read.parquet(SAMPLE)
    return df, df.toPandas().sort_values("doc_id", ignore_index=True)
