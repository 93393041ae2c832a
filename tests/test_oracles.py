"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry_point
from citeloom.plans.catalogue import QUERIES as CATALOGUE
from tests.comparing import differences, duck

# the training-data queries have tests of their own
QUERIES, ORACLES = dict(CATALOGUE), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES) and set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []
