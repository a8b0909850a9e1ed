import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=""):
        """documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def clash():
    """Adds columns with names that operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        names = ("id", "row", "cid", "n", "seg", "gone", "rate", "copy", "score", "toxic", "base", "digest", "sha", "label", "word", "h", "doc", "keep_id")
        return df.withColumns({c: F.lit("clash") for c in names})

    return add
