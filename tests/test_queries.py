"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"
OWN = sorted(q for q in entry.queries() if not q.startswith("op") and q != "pipeline")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    frame, sql = entry.queries()[name](spark, SF), entry.oracle_sql().get(name)
    if sql is None:
        frame.collect()
    else:
        assert difference(frame, con, sql) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "period", "n", "mean_fwd_3", "mean_mfe_7", "mean_mae_7"]
