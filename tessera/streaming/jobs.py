"""Structured Streaming forms: windowed counts with late data, and ledgers without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly bars of (event_type, ts, event_id, value); rows later than the watermark are left out."""
    at = F.struct("ts", "event_id", "value")
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def ledger(exits: DataFrame, keep: str = "365 days") -> DataFrame:
    """Each (symbol, exit_ts) once, remembered for the time given."""
    return exits.withWatermark("exit_ts", keep).dropDuplicatesWithinWatermark(["symbol", "exit_ts"])
