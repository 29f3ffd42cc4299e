"""The stream of live tests against the batch operators, with rows out of order and a restart."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.catalog import hourly
from tessera.operators import live
from tessera.streaming import live_tests as live_stream

START = dt.datetime(2024, 1, 1)
HORIZONS, SIGNS = {"up": 3, "down": 7}, {"up": 1, "down": -1}
KIND = "candidate string, coin string, ts timestamp, close double, high double, low double, fired boolean"


def bars(n: int = 60) -> list[tuple]:
    rng = random.Random(7)
    rows = []
    for coin in ("A", "B"):
        price = 100.0
        for k in range(n):
            price *= rng.uniform(0.95, 1.06)
            rows += [(c, coin, START + dt.timedelta(days=k), price, price * 1.02, price * 0.97, rng.random() < 0.4) for c in HORIZONS]
    return rows


def opened_and_closed(spark, rows):
    """What the batch operators say."""
    df = spark.createDataFrame(rows, KIND).withColumn("d", F.to_date("ts"))
    opened, tests = set(), []
    for candidate, horizon in HORIZONS.items():
        days = live.one_open_per_key(df.where((F.col("candidate") == candidate) & F.col("fired")), ["candidate", "coin"], horizon)
        opened |= {(r.candidate, r.coin, r.opened) for r in days.collect()}
    prices = {(r[0], r[1], r[2].date()): r[3] for r in rows}
    tests = [(c, coin, d, prices[c, coin, d], HORIZONS[c], SIGNS[c]) for c, coin, d in opened]
    open_tests = spark.createDataFrame(tests, "candidate string, coin string, entry_d date, entry_price double, horizon int, sign int")
    panel = df.where("candidate = 'up'").select(F.col("coin").alias("symbol"), "d", "high", "low", "close")
    last = max(r[2] for r in rows).date()
    closed = live.resolve(open_tests, panel, F.lit(last)).where("status = 'closed'")
    return opened, {(r.candidate, r.coin, r.entry_d, r.close_d, round(r.forward_return, 9), round(r.mfe, 9), round(r.mae, 9)) for r in closed.collect()}


@pytest.fixture
def stateful(spark):
    for k, v in live_stream.SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k in live_stream.SETTINGS:
        spark.conf.unset(k)


def run(spark, source: str, out: str, check: str) -> None:
    stream = live_stream.live_tests(spark.readStream.schema(KIND).parquet(source), HORIZONS, SIGNS, "4 days")
    stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()


def of_events(spark) -> list[tuple]:
    """Days of the events table: up fires on a day that rises, down on one that falls; no coin lacks a day."""
    days = hourly.days_of_hours(spark, "/root/testdata/sf0.01").orderBy("symbol", "d").collect()
    assert len(days) == len({r.symbol for r in days}) * len({r.d for r in days})
    at = lambda d: dt.datetime(d.year, d.month, d.day)
    return [(c, r.symbol, at(r.d), r.close, r.high, r.low, (r.close > r.open) == (c == "up")) for r in days for c in HORIZONS]


@pytest.mark.parametrize("source_of", [lambda spark: bars(), of_events], ids=["made", "events"])
def test_stream_equals_batch_over_a_restart(stateful, tmp_path, source_of):
    spark = stateful
    rows = source_of(spark)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rng = random.Random(1)
    jitter = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=rng.uniform(0, 3)))  # out of order, within the delay
    later = [("up", "Z", START + dt.timedelta(days=99), 1.0, 1.0, 1.0, False)]  # lets the watermark pass the rest
    third = len(jitter) // 3
    for part in (jitter[:third], jitter[third : 2 * third], jitter[2 * third :], later):  # each run starts anew from the checkpoint
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out, check)
    told = spark.read.parquet(out).collect()
    opened, closed = opened_and_closed(spark, rows)
    assert {(r.candidate, r.coin, r.opened.date()) for r in told if r.status == "open"} == opened and len(opened) > 20
    assert sum(r.status == "open" for r in told) == len(opened)
    assert {(r.candidate, r.coin, r.opened.date(), r.closed.date(), round(r.forward_return, 9), round(r.mfe, 9), round(r.mae, 9)) for r in told if r.status == "closed"} == closed


def test_questions_are_answered_or_expire(stateful, tmp_path):
    from tessera.streaming.pending import pending

    spark, rng = stateful, random.Random(3)
    source, out, check = (str(tmp_path / n) for n in ("q", "out", "check"))
    hour = dt.timedelta(hours=1)
    rows, want = [], set()
    for k in range(60):
        asked = START + rng.randrange(200) * hour
        rows.append(("q", f"{k}", asked, "asked"))
        wait = rng.choice([None, 1, 5, 24, 25, 60])
        if wait is not None:
            rows.append(("q", f"{k}", asked + wait * hour, "answered"))
        good = wait is not None and wait <= 24
        want.add((f"{k}", asked, "answered" if good else "expired", asked + (wait if good else 24) * hour))
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 5) * hour)  # out of order, within the delay
    kind = "queue string, id string, ts timestamp, kind string"
    for part in (rows[:50], rows[50:], [("end", "end", START + 900 * hour, "answered")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = pending(spark.readStream.schema(kind).parquet(source), 24 * 3600, "8 hours")
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    told = [(r.id, r.asked, r.outcome, r.at) for r in spark.read.parquet(out).collect()]
    assert len(told) == 60 and set(told) == want
