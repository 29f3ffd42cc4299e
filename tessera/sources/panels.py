"""Panels over the driver's tables: daily and hourly bars, funding, vintages, calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlc(df: DataFrame, keys: list[str], price: str, order: list[str], volume) -> DataFrame:
    """Bars by keys; the order ends with the price, so ties cannot change open or close."""
    at = F.struct(*order, price)
    return df.groupBy(*keys).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), volume.alias("volume"))


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of three symbols, without a join."""
    lines = table(spark, sf_dir, "lineitem").withColumn("symbol", F.col("l_returnflag")).withColumn("d", F.to_date("l_shipdate"))
    return ohlc(lines, ["symbol", "d"], "l_extendedprice", LINE_ORDER, F.sum("l_quantity"))


def bars_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of five symbols; the dimension tables are small, and Spark broadcasts them where it finds them so."""
    region = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supplier = table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("d", F.to_date("l_shipdate"))
    return ohlc(lines, ["symbol", "d"], "l_extendedprice", LINE_ORDER, F.sum("l_quantity"))


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "value")
    return ohlc(events, ["symbol", "hour"], "value", ["ts", "event_id"], F.count(F.lit(1))).withColumnRenamed("hour", "ts")


def funding_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side series of days for the symbols of the hourly bars: the mean value of the day."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d"), "value")
    return events.groupBy("symbol", "d").agg(F.avg("value").alias("rate"))


def error_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which more than a fifth of the events are errors."""
    by_day = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    return by_day.where(5 * F.col("errors") > F.col("n")).select("d")


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side series with gaps: the mean of each week, known on the Monday after it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.date_add(F.trunc(F.to_date("l_shipdate"), "week"), 7).alias("d"), "l_discount")
    return lines.groupBy("symbol", "d").agg(F.avg("l_discount").alias("rate"))


def macro_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vintages a month and series: a first print of the first 20 days, and a revision of all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.trunc(F.to_date("o_orderdate"), "month").alias("period"), F.dayofmonth("o_orderdate").alias("day"), "o_totalprice")
    by_month = lambda df, days: df.groupBy("series", "period").agg(F.round(F.avg("o_totalprice"), 4).alias("value")).select("series", "period", F.date_add(F.last_day("period"), days).alias("realtime_start"), "value")
    return by_month(orders.where("day <= 20"), 14).unionByName(by_month(orders, 45))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of first prints, and literal days."""
    first = macro_vintage(spark, sf_dir).groupBy("series", "period").agg(F.min("realtime_start").alias("d")).select("d")
    return first.unionByName(literal_days(spark)).distinct()


LITERAL_DAYS = ("1996-01-31", "1996-03-26", "1997-05-20", "1998-09-29", "1999-11-16")


def literal_days(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"(DATE '{d}')" for d in LITERAL_DAYS) + " AS t(d)")
