"""Every registered query with an oracle gives DuckDB's rows on the given tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

PLANS, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, sf_dir, name):
    got = PLANS[name](spark, sf_dir).toArrow()
    assert compare(got, duck.sql(ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(ORACLES)))
def test_runs_without_oracle(spark, sf_dir, name):
    assert PLANS[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
