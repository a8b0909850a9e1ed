import pytest

from wirelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf, duck, check):
    check(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


def test_names():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert "pipeline" in entry.queries()
