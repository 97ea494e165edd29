"""Every registered query with an oracle matches DuckDB on sf0.001."""

import pytest

from oracle_check import compare, duck
from seclog.plans.oracles import oracle_sql
from seclog.plans.queries import queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf, name):
    r = compare(spark, con, name, sf)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_oracle_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.count() >= 0
