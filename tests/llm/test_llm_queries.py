"""The registered queries over training text: with SQL they equal it, the others run and keep their columns apart."""

import pytest

from pagemill.llm import queries
from tests.oracle import compare, connect

Q, S = queries.QUERIES, queries.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(S))
def test_equals_sql(spark, con, sf, name):
    assert compare(spark, con, sf, name, Q[name], S[name]) == ""


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
