"""Corpus pipeline: toxicity, exact dedup, near-duplicate groups, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm import decontamination, exact_dedup, jaccard_join, mixing, toxicity
from wirelake.llm.common import stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5, whatever their language.

    Each row is scored by its own text: repeated rows and ids are judged alike, null ids as others, null and empty
    texts as the network's answer to no words, texts of any length whole. Columns pass as they are; an empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the smallest id; one row also where ids repeat or are null.

    Null and empty texts are one text, of which one row stays. Another text under a dropped id stays. Columns pass as
    they are; of rows that agree in id and text any one stays; an empty table stays empty.
    """
    return exact_dedup.without_copies(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more), the row with the smallest id.

    One row also where ids repeat or are null; another text under a dropped id stays. Texts without words are near nothing
    and stay. Columns pass as they are; an empty table stays empty.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Each row is judged by its own text: repeated rows and ids alike, null and empty texts leak nothing and stay, texts of any
    length are read whole. Columns pass as they are; an empty table stays empty, and an empty benchmark drops nothing.
    """
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at shares that go with the square root of their size, one epoch in all; adds the columns of mixing.ADDED.

    Rows of one id get the same count of copies; null ids and null sources are values like others; texts pass as they are.
    """
    return mixing.mix_sources(docs, temperature=0.5, epochs=1.0)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_copies", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The first stage is a trained classifier, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
