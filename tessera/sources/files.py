"""CSV series and vintages, and a fan-out over many sources of which some may fail."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark._jsc.hadoopConfiguration()).exists(of)


def daily_means(spark: SparkSession, path: str, symbol: str, time: str = "timestamp", value: str = "rate") -> DataFrame | None:
    """symbol, d, rate of a CSV file with several readings a day, or None where there is no file."""
    if not exists(spark, path):
        return None
    rows = spark.read.csv(path, header=True).select(F.to_date(time).alias("d"), F.col(value).cast("double").alias("rate"))
    return rows.groupBy("d").agg(F.avg("rate").alias("rate")).select(F.lit(symbol).alias("symbol"), "d", "rate")


def vintages(spark: SparkSession, paths: dict[str, str], period: str = "date", published: str = "realtime_start") -> DataFrame:
    """series, period, realtime_start, value of CSV files, one a series, whose value column has a name of its own."""
    empty = spark.createDataFrame([], "series string, period date, realtime_start date, value double")
    for series, path in paths.items():
        if exists(spark, path):
            rows = spark.read.csv(path, header=True)
            (value,) = [c for c in rows.columns if c not in (period, published)]
            empty = empty.unionByName(rows.select(F.lit(series).alias("series"), F.to_date(period).alias("period"), F.to_date(published).alias("realtime_start"), F.expr(f"try_cast(`{value}` as double)").alias("value")))
    return empty


@lru_cache(maxsize=8)
def release_dates(spark: SparkSession, path: str, after: str = "2017-01-01", published: str = "realtime_start") -> tuple:
    """Ascending days of publication after a day; none where there is no file.  One column is read, once an application."""
    if not exists(spark, path):
        return ()
    days = spark.read.csv(path, header=True).select(F.to_date(published).alias("d")).where(F.col("d") > F.lit(after).cast("date")).distinct().orderBy("d")
    return tuple(r.d for r in days.collect())


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; what is no number is written as missing."""
    from tessera.operators.walkforward import without_nan

    without_nan(df).write.mode("overwrite").csv(path, header=True)


def fan_out(spark: SparkSession, jobs: dict[tuple[str, str], Callable[[], int]]) -> DataFrame:
    """symbol, kind, rows, error: each job by itself; rows is 0 where nothing was new and null where it failed, and error says why."""
    done = []
    for (symbol, kind), job in jobs.items():
        try:
            done.append((symbol, kind, int(job()), None))
        except Exception as e:  # a source that fails must not keep the others from their rows; the report carries it
            done.append((symbol, kind, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(done, "symbol string, kind string, rows long, error string")
