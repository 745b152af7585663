"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from railpulse.plans.compare import compare, duck
from conftest import SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    r = compare(df, con, ORACLE[name])
    assert r["cols_match"], r
    assert r["hash_match"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "position_confidence" in df.columns
