import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def same(df, duck, sql):
    """Asserts that Spark's rows are DuckDB's, whatever their order."""
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = sorted((tuple(near(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(near(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert ours == theirs


@pytest.fixture(scope="session")
def check():
    return same
