"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from oracle_compare import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= set(E._llm()[0])


@pytest.mark.parametrize("name", sorted(set(SQL) - set(E._llm()[0])))
def test_query_matches_oracle(spark, con, name):
    problems, n_spark, n_duck = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert not problems, problems
