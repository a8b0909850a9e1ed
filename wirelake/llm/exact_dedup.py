"""Exact deduplication through a log-structured merge index, in DataFrame operations only.

Memtables are the scan's partitions: each flushes one run, a file sorted by a 64-bit digest that
carries min/max fences and a Bloom filter on the digest. Compaction, a hash aggregation that uses
neither order nor filters, brings the runs to one entry for each content key and keeps the smallest
(or largest) identifier. Entries that occur more than once are hits: their rows are found again through a bitmap whose size goes with their number, within bounds, and grouped by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.common import ROW_BITS, ascii_fold, bitmap_rows, filter_bits, keep_one, stage, table

#: A group is hot from this share of the rows; there can't be more hot groups than its inverse.
HOT_SHARE = 0.001


def flush_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sorted digest runs of docs, one for each partition: (id, digest, sha), with a filter in each file."""
    folded = ascii_fold(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(folded).alias("digest"),
        F.unhex(F.sha2(folded, 256)).alias("sha"),
    ).sortWithinPartitions("digest")
    return stage(rows, "digest-run", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"})


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One entry for each content key over all runs: (digest, sha, keep_id, group_size)."""
    best = F.min("id") if keep == "smallest" else F.max("id")
    return runs.groupBy("digest", "sha").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def verify_bytes(docs: DataFrame, hits: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hits' groups made anew from the bytes of the texts, so equal digests alone never join two rows.

    The filter of the hits is broadcast: 64 MiB at most. Map-side aggregation
    leaves one copy of a text for each task. Two texts under one key end the job.
    """
    folded = ascii_fold(F.col(text_col))
    bits = filter_bits(hits.count())
    spot = F.pmod(F.col("digest"), F.lit(bits))
    found = (
        docs.select(F.col(id_col).alias("id"), folded.alias("body"))
        .withColumn("digest", F.xxhash64("body"))
        .withColumn("bucket", F.floor(spot / ROW_BITS).cast("int"))
        .withColumn("bit", F.pmod(spot, F.lit(ROW_BITS)).cast("int"))
        .join(F.broadcast(bitmap_rows(hits, F.col("digest"), bits)), "bucket")
        .where(F.expr("bit_get(cast(conv(hex(substring(bitmap, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) = 1"))
    )
    best = F.min("id") if keep == "smallest" else F.max("id")
    exact = found.groupBy("digest", "body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    keyed = exact.select("digest", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    return (
        keyed.where("group_size > 1")
        .groupBy("digest", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one content key"))).otherwise(F.col("group_size")))
        .drop("texts")
    )


def grouped_rows(docs: DataFrame, keep: str, id_col: str, text_col: str) -> DataFrame:
    """(digest, sha, id, keep_id, group_size) for each row of docs; the last two are null where the text occurs once."""
    runs = flush_runs(docs, id_col, text_col)
    index = stage(compact(runs, keep).where("group_size > 1"), "digest-index")
    groups = stage(verify_bytes(docs, index, keep, id_col, text_col), "digest-verified")
    total = runs.count()
    hot = groups.where(F.col("group_size") > HOT_SHARE * total)
    large = groups.where(F.col("group_size") <= HOT_SHARE * total)
    # at most 1 / HOT_SHARE hot groups can exist, so they are broadcast; the rest meets no hot key
    first = runs.join(F.broadcast(hot), ["digest", "sha"], "left")
    rest = first.where("group_size is null").select("digest", "sha", "id").join(large, ["digest", "sha"], "left")
    return first.where("group_size is not null").select("digest", "sha", "id", "keep_id", "group_size").unionByName(rest)


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty; empty texts form
    a group like any other. A null id never beats another id; a row is kept when its id is the
    group's keep_id (null-safe), so repeated rows with the kept id all stay (without_copies keeps one of them). Texts may
    have any length; other columns are ignored; an empty table gives an empty result.
    """
    out = grouped_rows(docs, keep, id_col, text_col)
    single = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each text, all columns as they are: the row of the smallest (or largest) id.

    Rows are told apart by id and text, so repeated and null ids lose no text: a group of null ids alone keeps one row, and
    so does a group whose kept id occurs several times.
    """
    rows = grouped_rows(docs, keep, id_col, text_col)
    single = F.col("group_size").isNull()
    kept = single | F.col("id").eqNullSafe(F.col("keep_id"))
    return keep_one(docs, rows.select("id", F.col("digest").alias("mark"), F.when(~single, F.col("sha")).alias("grp"), kept.alias("kept")), id_col, text_col)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


SQL = {
    "op6_exact_dedup": """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
}
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
