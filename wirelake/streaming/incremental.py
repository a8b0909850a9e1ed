"""Incremental re-analysis: which files to analyse anew, merging results, deltas between indexes, streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelake.sources.schemas import REPO


def valid_cache(cache: DataFrame, version: int) -> DataFrame:
    return cache.where(F.col("result").isNotNull() & (F.col("cache_version") == version))


def to_analyse(current: DataFrame, changed: DataFrame, cached: DataFrame) -> DataFrame:
    """Current files that changed or have no cached result."""
    return current.join(changed, "file", "left_semi").unionByName(current.join(changed, "file", "left_anti").join(cached, "file", "left_anti"))


def merge(current: DataFrame, changed: DataFrame, cached: DataFrame, new: DataFrame) -> DataFrame:
    """(file, result): cached results of current unchanged files, replaced by new ones."""
    kept = cached.join(current, "file", "left_semi").join(changed, "file", "left_anti").join(new, "file", "left_anti")
    return kept.select("file", "result").unionByName(new.select("file", "result"))


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows that are new in after or removed from before."""
    a, b = after.select(*keys).distinct(), before.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(b.join(a, keys, "left_anti").withColumn("change", F.lit("removed")))


def replace_own(peers: DataFrame, own: DataFrame, owner: str) -> DataFrame:
    return peers.where(F.col("owner_id") != owner).unionByName(own)


def latest(repos: DataFrame) -> DataFrame:
    """The last document of each repository and service."""
    order = Window.partitionBy("repo_name", F.coalesce("service_name", F.lit(""))).orderBy(F.desc("last_updated"), F.desc("commit_hash"))
    return repos.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def watch(spark: SparkSession, path: str, analyse: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs analyse on each micro-batch of stored documents, the latest of each service only."""
    stream = spark.readStream.schema(REPO).option("recursiveFileLookup", True).json(path)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, epoch: analyse(latest(df), epoch)).start()
