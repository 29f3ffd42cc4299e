"""Pairs of labels from bitmaps against sets of firings."""

from __future__ import annotations

import datetime as dt
import random
from itertools import combinations

import pytest

from tessera.operators.bitmaps import jaccard, pairs

KIND = "label string, symbol string, d date"


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_sets(spark, seed):
    """Days before and after the epoch, over many blocks; one symbol with most rows; repeated and null firings."""
    rng = random.Random(seed)
    rows = [(f"l{rng.randrange(14)}", rng.choice("aaaaab"), dt.date(1950, 1, 1) + dt.timedelta(days=rng.choice([rng.randrange(300), rng.randrange(30_000)]))) for _ in range(3000)]
    rows += rows[:200] + [("lone", "z", dt.date(2000, 1, 1)), (None, "a", dt.date(2000, 1, 1)), ("l1", None, dt.date(2000, 1, 1)), ("l1", "a", None)]
    sets: dict[str, set] = {}
    for label, *key in rows:
        if label and all(key):
            sets.setdefault(label, set()).add(tuple(key))
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2)}
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert {(r.a, r.b): (r.both, r.n_a, r.n_b) for r in pairs(df, all_pairs=True).collect()} == want
    assert {(r.a, r.b): (r.both, r.n_a, r.n_b) for r in pairs(df).collect()} == {k: v for k, v in want.items() if v[0]}
    assert all(abs(r.jaccard - want[r.a, r.b][0] / len(sets[r.a] | sets[r.b])) < 1e-12 for r in jaccard(df).collect())


def test_firings_meet_as_words(spark):
    df = spark.createDataFrame([("x", "a", dt.date(2000, 1, 1))], KIND)
    plan = pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("d#" not in line for line in joins) and not any("Cartesian" in line for line in joins)


def test_nothing(spark):
    assert pairs(spark.createDataFrame([], KIND), all_pairs=True).count() == 0
