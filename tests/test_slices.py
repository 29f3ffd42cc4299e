"""Panels cut by time against uncut ones; scans against row-after-row loops; bars of hours."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import slices
from tessera.functions.series import ahead, by_day, filled, past, roll
from tessera.operators import indicators as I  # noqa: E741
from tessera.plans import grammar as G
from tessera.plans.grammar import Clause, Spec

START = dt.datetime(2020, 1, 1)


def panel(spark, sizes: dict[str, int], seed: int = 1, step: dt.timedelta = dt.timedelta(hours=1)):
    """Bars at uneven times: bursts, gaps, and volumes that are often null."""
    rng = np.random.default_rng(seed)
    rows = []
    for symbol, n in sizes.items():
        places = np.cumsum(rng.choice([1, 1, 1, 2, 40], n))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for k in range(n):
            c = float(close[k])
            rows.append((symbol, START + int(places[k]) * step, c * float(rng.uniform(0.98, 1.02)), c * 1.03, c * 0.97, c, None if rng.random() < 0.4 else float(rng.integers(1, 99))))
    return spark.createDataFrame(rows, "symbol string, d timestamp, open double, high double, low double, close double, volume double")


def same(a, b) -> None:
    key = lambda r: (r.symbol, r.d)
    x, y = sorted(a.collect(), key=key), sorted(b.select(a.columns).collect(), key=key)
    assert len(x) == len(y) > 0
    for p, q in zip(x, y):
        for u, v in zip(p, q):
            assert (u is None) == (v is None) and (u is None or (math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) if isinstance(u, float) else u == v)), (p, q)


def frames(df):
    one = df.withColumns({
        "mean": F.avg("close").over(roll(9)), "p95": F.percentile("volume", F.lit(0.95)).over(past(12)), "best": F.max("high").over(ahead(2, 7)), "lag": F.lag("close", 5).over(by_day()),
        "lead": F.lead("close", 4).over(by_day()), "any": F.max(F.col("close") > F.col("open")).over(roll(3)),
    })
    return one.withColumn("chain", F.stddev_samp("mean").over(roll(11)))


@pytest.mark.parametrize("rows", [7, 31, 1000])
def test_frames_in_slices_are_those_of_the_whole(spark, rows):
    bars = panel(spark, {"a": 400, "b": 1, "c": 33}).repartition(5)
    plain = frames(bars.withColumns({"loc": (F.row_number().over(by_day()) - 1).cast("long"), "n_rows": F.count(F.lit(1)).over(by_day().rowsBetween(-(10**6), 10**6))}))
    same(slices.over_slices(slices.located(bars, rows), frames, 20, 7, rows), plain)


@pytest.mark.parametrize("rows", [5, 64])
def test_values_from_the_start(spark, rows):
    bars = panel(spark, {"a": 300, "b": 40}, 2)
    placed = slices.located(bars, rows)
    plain = bars.withColumns({"volume_before": filled("volume"), "total": F.coalesce(F.sum("volume").over(by_day().rowsBetween(-(10**6), 0)), F.lit(0.0))})
    got = slices.summed(placed, {"total": F.col("volume")}, rows)
    got = slices.filled(got.withColumn("volume_before", F.col("volume")), "volume_before", rows=rows)
    same(got.drop("loc", "n_rows"), plain)


def test_values_carried_onto_other_times(spark):
    known = spark.createDataFrame([("a", START + dt.timedelta(days=k), float(k)) for k in range(0, 60, 3)], "symbol string, t timestamp, v double")
    onto = spark.createDataFrame([(s, START + dt.timedelta(hours=11 * k - 30)) for k in range(120) for s in "ab"], "symbol string, t timestamp")
    for r in slices.carried(known, onto, "v", rows=9).collect():
        before = [k for k in range(0, 60, 3) if START + dt.timedelta(days=k) <= r.t]
        assert r.v == (float(before[-1]) if r.symbol == "a" and before else None)


def test_scans(spark):
    bars = panel(spark, {"a": 3000, "b": 1, "c": 33, "d": 32}, 3)
    x = F.col("volume")
    got = slices.scanned(slices.located(bars, 100), {"m": slices.mean_step(x, 0.1), "n": slices.count_step(x)})
    for symbol, p in got.orderBy("d").toPandas().groupby("symbol"):
        state, n = None, 0
        for v, m, count in zip(p["volume"], p["m"], p["n"]):
            if not math.isnan(v):
                state, n = v if state is None else 0.9 * state + 0.1 * v, n + 1
            assert count == n or (n == 0 and (math.isnan(count) or count == 0))
            assert math.isnan(m) if state is None else math.isclose(m, state, rel_tol=1e-12), symbol


def test_one_long_symbol_is_many_tasks(spark):
    n = 120_000
    bars = spark.range(n).select(F.when(F.col("id") < n - 50, "hot").otherwise("cold").alias("symbol"), (F.lit(START) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("d"), F.sin(F.col("id") / 50).alias("close"))
    placed = slices.located(bars, 1000)
    per = placed.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in per) < 0.5 * n
    made = slices.over_slices(placed, lambda df: df.withColumn("m", F.avg("close").over(roll(20))), 20, 0, 1000)
    assert made.where("symbol = 'hot'").agg(F.max("loc"), F.count_distinct("loc")).first() == (n - 51, n - 50)
    plain = bars.withColumn("m", F.avg("close").over(roll(20)))
    assert made.agg(F.round(F.sum("m"), 6)).first() == plain.agg(F.round(F.sum("m"), 6)).first()


def strength_by_hand(p: pd.DataFrame, n: int = 14):
    """Row after row."""
    rsi, atr, up, down, span = [], [], None, None, None
    for k, (h, lo, c) in enumerate(zip(p["high"], p["low"], p["close"])):
        before = p["close"].iloc[k - 1] if k else None
        step = lambda s, v: v if s is None else s + (v - s) / n
        span = step(span, max([h - lo] + ([abs(h - before), abs(lo - before)] if k else [])))
        if k:
            up, down = step(up, max(c - before, 0.0)), step(down, max(before - c, 0.0))
        rsi.append(100 * up / (up + down) if k >= n and up + down > 0 else None)
        atr.append(span / c if k >= n - 1 else None)
    return rsi, atr


@pytest.mark.parametrize("rows", [11, 4096])
def test_strength_and_range(spark, rows):
    bars = panel(spark, {"a": 200, "b": 14, "c": 13, "d": 1}, 4)
    got = I.wilder(bars, rows=rows).orderBy("d").toPandas()
    for symbol, p in bars.orderBy("d").toPandas().groupby("symbol"):
        mine = got[got["symbol"] == symbol]
        for a, b in zip(strength_by_hand(p), (mine["rsi"], mine["atr_pct"])):
            assert len(a) == len(b)
            assert all(math.isnan(y) if x is None else math.isclose(x, y, rel_tol=1e-10) for x, y in zip(a, b))


def test_histogram_crossings(spark):
    falling = spark.createDataFrame([("f", START + dt.timedelta(days=k), 100.0 - k) for k in range(40)], "symbol string, d timestamp, close double")
    got = [r.crossed for r in I.macd_cross(falling, rows=9).orderBy("d").collect()]
    assert not got[0] and got[1]  # from no sign to below
    bars = panel(spark, {"a": 150, "b": 30}, 5)
    found = I.macd_cross(bars, rows=40).orderBy("d").toPandas()
    for symbol, p in bars.orderBy("d").toPandas().groupby("symbol"):
        mean = lambda x, span: x.ewm(span=span, adjust=False).mean()
        line = mean(p["close"], 12) - mean(p["close"], 26)
        side = np.sign(line - mean(line, 9)).to_numpy()
        assert found[found["symbol"] == symbol]["crossed"].tolist() == [False, *(side[1:] != side[:-1])]


def test_days_become_hours(spark):
    """Windows of days on bars of hours: 480 rows for 20 days, 720 for 30, and so on."""
    n = 900
    rng = np.random.default_rng(6)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    p = pd.DataFrame({"d": [START + dt.timedelta(hours=k) for k in range(n)], "close": close, "high": close * 1.01, "low": close * 0.99, "open": close, "volume": rng.integers(1, 50, n).astype(float)})
    funding = pd.DataFrame({"d": [(START + dt.timedelta(days=k)).date() for k in range(0, 37, 2)], "rate": rng.normal(size=19)})
    bars = spark.createDataFrame(p.assign(symbol="a"))
    got = I.complete(bars, spark.createDataFrame(funding.assign(symbol="a")), scale=24, rows=200, static=True).orderBy("d").toPandas()
    low, high = p["low"].rolling(480).min(), p["high"].rolling(480).max()
    mean, sd = p["close"].rolling(480).mean(), p["close"].rolling(480).std()
    low14, high14 = p["low"].rolling(336).min(), p["high"].rolling(336).max()
    rate = pd.Series([funding.set_index("d")["rate"].get(t.date()) if t.hour == 0 else None for t in p["d"]], dtype=float).ffill()
    z = lambda x: (x - x.rolling(720, min_periods=360).mean()) / x.rolling(720, min_periods=360).std()
    want = {
        "close_return_1d": p["close"].pct_change(24), "close_return_5d": p["close"].pct_change(120), "donchian_pct_20d": (p["close"] - low) / (high - low), "bollinger_pctb_20d": (p["close"] - mean + 2 * sd) / (4 * sd),
        "stochastic_k_14d": 100 * (p["close"] - low14) / (high14 - low14), "volume_zscore_30d": z(p["volume"]), "funding_zscore_30d": z(rate),
    }
    for name, x in want.items():
        assert x.notna().sum() > 100
        pd.testing.assert_series_equal(got[name], x, check_names=False, rtol=1e-7, atol=1e-9)
    moved = p["close"].diff().abs().rolling(480).sum()
    strong = ((p["close"] - p["close"].shift(480)).abs() / moved > 0.4) & (p["volume"] > 1.8 * p["volume"].rolling(480, min_periods=240).mean())
    assert got["c6_long"].tolist() == (strong & (p["close"].pct_change(120) > 0)).astype(int).tolist()
    assert got["c1_short"].tolist() == (z(rate) > 2).astype(int).tolist()


def test_conditions_of_days_hold_on_their_hours(spark):
    rng = np.random.default_rng(0)
    close = (100 * np.cumprod(1 + rng.normal(0, 0.03, 120))).tolist()
    bar = lambda t, c: ("a", t, c, c * 1.02, c * 0.98, c, 1000.0)
    kind = "symbol string, d {}, open double, high double, low double, close double, volume double"
    days = I.complete(spark.createDataFrame([bar((START + dt.timedelta(days=k)).date(), c) for k, c in enumerate(close)], kind.format("date")))
    hours = spark.createDataFrame([bar(START + dt.timedelta(days=k, hours=h), c) for k, c in enumerate(close) for h in range(0, 24, 3)], kind.format("timestamp"))
    spec = Spec("weak", (Clause("rsi_14d", "<", 45.0),))
    by_day_ = {r.d for r in G.occurrences(days, [spec]).collect()}
    by_hour = {r.ts.date() for r in G.occurrences_hourly(I.complete(hours, scale=24, daily=days), days, [spec]).collect()}
    assert by_day_ and by_day_ == by_hour
