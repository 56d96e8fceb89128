"""Every query with an oracle equals its DuckDB SQL on the sf0.001 tables
(the driver checks sf0.01 the same way)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import check, duck

from conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    line, ok = check(spark, con, name, E.queries()[name], ORACLES[name], SF_SMALL)
    assert ok, line


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "home_form" in df.columns
