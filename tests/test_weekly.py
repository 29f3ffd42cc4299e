"""The as-of axis: verdicts of many days in one plan are those of a run for each day."""

from __future__ import annotations

import datetime as dt
import math

from tessera.catalog.studies import SPECS, sides_of
from tessera.plans import study
from tessera.plans.grammar import Clause, Spec
from tessera.sources import panels

SF = "/root/testdata/sf0.001"
#: The last days of years, days on which horizons end, and one before there is anything.
DAYS = [dt.date(1990, 1, 1), dt.date(1999, 6, 30), dt.date(1999, 12, 31), dt.date(2000, 1, 12)]


def test_verdicts_of_many_days_equal_single_runs(spark):
    bars, sides = panels.bars_1d(spark, SF), sides_of(spark, SF)
    specs = [SPECS[1], Spec("apart", (Clause("volume_zscore_30d", ">=", 0.8, 2),), "short", (1, 3), outcome="market_relative"), Spec("unknown", (Clause("nothing", ">", 0.0),))]
    whole = {}
    for r in study.run(bars, specs, list(DAYS), 200, sides, True).collect():
        whole.setdefault(r.as_of, {})[r.candidate] = r.asDict()
    assert set(whole) == set(DAYS) and all(len(v) == 9 for v in whole.values())
    assert len({v["volume_range"]["n"] for v in whole.values()}) > 2
    for day in DAYS[1:3]:
        for r in study.run(bars, specs, day, 200, sides, True).collect():
            for name, value in r.asDict().items():
                mine = whole[day][r.candidate][name]
                assert math.isclose(mine, value, rel_tol=1e-9, abs_tol=1e-12) if isinstance(value, float) and isinstance(mine, float) else mine == value, (day, r.candidate, name)


def test_nothing_after_the_day_is_seen(spark):
    """A run for a day is a run over a panel that ends on it, and later bars change nothing."""
    bars, day = panels.bars_1d(spark, SF), dt.date(2000, 1, 8)
    key = lambda df: [(r.candidate, r.n, r.status, r.baseline_n, round(r.mean, 9), round(r.sortino, 6), round(r.p, 6)) for r in df.collect()]
    cut_off = bars.where(bars.d <= day)
    assert key(study.run(bars, SPECS[:1], day, 100)) == key(study.run(cut_off, SPECS[:1], None, 100))
