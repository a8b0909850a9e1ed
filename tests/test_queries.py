import pytest

import __spark_entry__ as entry
from wirelake.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf, duck, check):
    check(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
