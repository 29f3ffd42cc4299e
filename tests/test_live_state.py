"""What a battery's verdicts set going, and indicators that users add."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from tessera.functions.series import by_day
from tessera.operators import indicators as I  # noqa: E741
from tessera.operators import walkforward
from tessera.plans import grammar as G
from tessera.plans import study

BATTERY = "candidate string, status string, fdr_demoted boolean, live_anchors map<int,struct<mfe:double,mae:double>>, live_tp double, live_sl double"


def battery(spark):
    anchors = {3: (0.05, 0.02), 7: (0.09, 0.04)}
    return spark.createDataFrame([("good", "accepted", False, anchors, 0.8, 1.2), ("no_fold", "accepted", False, anchors, None, None), ("demoted", "rejected", True, None, None, None), ("weak", "watch", False, None, None, None)], BATTERY)


def test_live_state_holds_accepted_candidates_only(spark):
    got = sorted(tuple(r) for r in study.live_state(battery(spark)).collect())
    assert got == [("good", 3, 0.05, 0.02, 0.8, 1.2), ("good", 7, 0.09, 0.04, 0.8, 1.2)]


def test_demoted_candidates_leave_and_the_last_drop_shuts_down(spark):
    live = spark.createDataFrame([("good",), ("demoted",)], "candidate string")
    assert [r.candidate for r in walkforward.live_after(live, battery(spark)).collect()] == ["good"]
    names = [r.candidate for r in battery(spark).collect()]
    dropped = lambda n: spark.createDataFrame([(c,) for c in names[:n]], "candidate string")
    assert not study.shutdown(battery(spark), dropped(3)) and study.shutdown(battery(spark), dropped(4))


def test_accepted_verdicts_carry_anchors_and_multiples(spark):
    """Prices that rise steadily after every firing: accepted, with the means of all events and the last fold's setting."""
    rows, price, day = [], 100.0, dt.date(2000, 1, 1)
    for k in range(2600):
        fires = k % 12 == 0
        price *= 1.03 if k % 12 in (2, 3, 4) else 0.992
        rows.append(("s" + str(k % 3), day + dt.timedelta(days=k), price, price * 1.01, price * 0.995, price * 1.002, 1000.0 if fires else float(10 + k % 7)))
    bars = spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double")
    whole = bars.select(F.explode(F.array(*map(F.lit, ("a", "b", "c")))).alias("symbol"), "d", "open", "high", "low", "close", "volume")
    got = study.run(whole, [G.Spec("spike", (G.Clause("volume_zscore_30d", ">=", 2.0),), horizons=(1, 3))], reps=300).first()
    assert got.n_raw_triggers >= got.n > 20 and got.n_shock_excluded >= 0
    if got.status == "accepted":
        assert set(got.live_anchors) == {1, 3} and got.live_anchors[3]["mfe"] > 0 and got.live_tp in (0.6, 0.8, 1.0, 1.2, 1.5) and got.live_sl in (0.6, 0.8, 1.0, 1.2, 1.5)
    else:
        assert got.live_anchors is None and got.live_tp is None


def test_indicators_can_be_added(spark):
    """A new one is in every complete panel, on days and in slices, in readings and in conditions; a daily one holds on hours."""
    I.register("gap_pct", lambda k: F.try_divide(F.col("open"), F.lag("close").over(by_day())) - 1, "gap at the open", neutral=0.0, daily_native=True)
    try:
        start = dt.date(2020, 1, 1)
        rows = [("a", start + dt.timedelta(days=k), 100.0 + (k % 5), 107.0, 99.0, 101.0, 5.0) for k in range(40)]
        kind = "symbol string, d {}, open double, high double, low double, close double, volume double"
        days = I.complete(spark.createDataFrame(rows, kind.format("date")), rows=7)
        values = {r.d: r.gap_pct for r in days.collect()}
        assert values[start] is None and all(math.isclose(values[start + dt.timedelta(days=k)], (100.0 + k % 5) / 101.0 - 1) for k in range(1, 40))
        assert "gap_pct" in I.from_bars() and "gap_pct" in I.named("daily_native")
        spec = G.Spec("gap", (G.Clause("gap_pct", ">", 0.02),))
        fired = {r.d for r in G.occurrences(days, [spec]).collect()}
        assert fired == {start + dt.timedelta(days=k) for k in range(1, 40) if k % 5 == 4}
        hours = spark.createDataFrame([("a", dt.datetime(2020, 1, 1) + dt.timedelta(hours=6 * k), 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(160)], kind.format("timestamp"))
        on_hours = G.occurrences_hourly(I.complete(hours, scale=24, daily=days), days, [spec])
        assert {r.ts.date() for r in on_hours.collect()} == fired
        assert "gap at the open" in spec.in_words()
    finally:
        del I.INDICATORS["gap_pct"]
