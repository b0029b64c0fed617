"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check_oracles import compare, connect
from tidewell.registry.oracles import ORACLES
from tidewell.registry.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, connection, name):
    ok, text = compare(spark, connection, name, FOLDER)
    assert ok, text


def test_entry(spark):
    assert entry_points.entry(spark).count() == 120
