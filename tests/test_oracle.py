import pytest
from oracle import same

import __spark_entry__ as entry
from pairlace.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns
