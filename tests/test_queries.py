"""Every registered query next to its SQL twin, on the smallest tables."""

import os

import pytest

from catalog.check import compare, connect
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF).startswith("ok")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    # Training-data queries come on top; not all of those have a twin in SQL.
    assert QUERIES.keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
