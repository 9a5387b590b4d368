"""Every registered query against its SQL on the smallest given tables."""

import pytest

import check

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(DATA)


@pytest.mark.parametrize("name", sorted(check.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert check.compare(spark, con, DATA, name) == ""


def test_every_query_of_the_library_has_sql():
    from snapfold.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
