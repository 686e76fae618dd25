"""Every query with a relational definition against its DuckDB oracle on the
smallest driver tables (the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, duck

from .conftest import SF0001

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, detail = compare(E.queries()[name](spark, SF0001), con, E.oracle_sql()[name])
    assert ok, detail


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["assigned_team", "resolved_team", "n"] and df.count() > 0
