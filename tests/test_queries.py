"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    wrong, _ = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR, db)
    assert not wrong, wrong


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert not {n for n in set(entry.queries()) - set(entry.oracle_sql()) if n.startswith("q_")}
