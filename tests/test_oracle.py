import pytest
from oracle import check

import __spark_entry__ as e

NAMES = [n for c in e._catalogs() if not c.__class__.__module__.startswith("evalmill.llm") for n in c.sql if not n.startswith("p2_")]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, small):
    check(name, spark, small)


def test_entry(spark):
    assert e.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
