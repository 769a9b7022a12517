"""Every registered query against its SQL oracle on the same files."""

import os

import pytest
from conftest import SF
from oracle import compare, connect, explain_difference

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not mounted")
def test_query_matches_oracle(spark, duck, name):
    got, want = compare(spark, duck, entry.queries()[name], ORACLES[name], SF)
    assert got == want, explain_difference(got, want)
    assert got[1], "no rows compared"
