"""Package manifests and service configurations of repositories, and the hashes that gate what is made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.sources.index import IGNORED_DIRS

MAPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
MANIFEST = "name STRING, version STRING, " + ", ".join(f"{m} MAP<STRING,STRING>" for m in MAPS)
SETS = ("internalEnvVars", "externalEnvVars", "internalDomains", "externalDomains")
SERVICE = "serviceName STRING, name STRING, directory STRING, tsconfig STRING, include ARRAY<STRING>, " + ", ".join(f"{s} ARRAY<STRING>" for s in SETS)
CONFIG = f"{SERVICE}, services ARRAY<STRUCT<{', '.join(x.strip().replace(' ', ': ', 1) for x in SERVICE.split(','))}>>"


def files_named(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, text) of the files of that name below root, outside ignored directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    below = F.substring(F.regexp_replace("path", "^[a-z]+:/+", "/"), len(root.rstrip("/")) + 2, 1 << 20)
    dirs = F.split(below, "/")
    return files.where(~F.exists(F.slice(dirs, 1, F.size(dirs) - 1), lambda d: d.isin(*IGNORED_DIRS))).select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_manifests(files: DataFrame) -> DataFrame:
    """(path, name, version, dependencies, ...) of package manifests (path, text); a text that is no JSON ends the job."""
    parsed = F.from_json("text", MANIFEST, {"mode": "FAILFAST"})
    return files.select("path", parsed.alias("m")).select("path", "m.*")


def internal_names(files: DataFrame) -> DataFrame:
    """The package names that the repository itself declares; texts that are no JSON declare none."""
    name = F.get_json_object("text", "$.name")
    return files.select(name.alias("name")).where("name is not null").distinct()


def read_services(files: DataFrame) -> DataFrame:
    """(path, service, directory, ...): one row for each service of the configurations (path, text): those of services, else the flat fields."""
    c = files.select("path", F.from_json("text", CONFIG, {"mode": "FAILFAST"}).alias("c"))
    flat = F.struct(*(F.col(f"c.{x.split()[0]}") for x in SERVICE.replace(", ", ",").split(",")))
    listed = F.when(F.size(F.coalesce("c.services", F.array())) > 0, F.col("c.services")).otherwise(F.array(flat))
    rows = c.select("path", F.posexplode(listed).alias("place", "s")).select("path", "place", "s.*")
    empty = {s: F.coalesce(s, F.array().cast("array<string>")) for s in SETS}
    return rows.withColumns({"service": F.coalesce("name", "serviceName"), **empty}).drop("name", "serviceName")


def merge_services(services: DataFrame) -> DataFrame:
    """One row: the union of all services' declarations, and the first service name by path and place."""
    named = F.min_by("service", F.when(F.col("service").isNotNull(), F.struct("path", "place"))).alias("service")
    return services.agg(named, *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in SETS))


def manifests_hash(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, hash): a hash of each repository's manifests (by, path, text) in the order of their paths."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda f: F.concat(f["path"], F.lit("\0"), F.coalesce(f["text"], F.lit("")), F.lit("\0"))), "")
    return files.groupBy(*by).agg(F.sha2(joined, 256).alias("hash"))


def reusable(cached: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """cached (by, hash, result) whose manifests are as they were; no hash is never one."""
    return cached.join(now.select(*by, F.col("hash").alias("current")), by).where("hash = current").drop("current")


def remembered(functions: DataFrame, memo: DataFrame) -> DataFrame:
    """functions (id, content_hash) with the intent that was found for the same content, if one was."""
    known = memo.where("intent is not null").groupBy("content_hash").agg(F.min("intent").alias("intent"))
    return functions.join(known, "content_hash", "left")
