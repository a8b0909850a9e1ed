"""Reading and writing the index, and other files around a repository."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.urls import Config
from wirelake.sources.schemas import DEFAULTS, REPO

# Directories that scans skip, directories of tests (skipped) and of mocks (scanned and marked), endings of sources and tests.
IGNORED_DIRS = ("node_modules", "dist", "build", ".next")
TEST_DIRS = ("__tests__", "__mocks__", "__fixtures__", "tests", "test", "fixtures", ".storybook")
MOCK_DIRS = ("mocks", "mock")
SOURCES = r"\.(js|ts|jsx|tsx)$"
TEST_FILE = r"(?i)\.(test|spec|stories)\.(js|ts|jsx|tsx)$"


def write_index(repos: DataFrame, path: str) -> None:
    """One JSON document for each (repository, service), in folders by both. Documents of others that are there stay."""
    keyed = repos.withColumns({"repo": F.regexp_replace("repo_name", "[/\\\\]", "_"), "service": F.coalesce(F.regexp_replace("service_name", "[/\\\\]", "_"), F.lit("_"))})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "service").json(path)


def read_index(spark: SparkSession, path: str, isolate: bool = False) -> DataFrame:
    """All stored documents with owner_id and an ordinal by file and place; a bad document ends the job. isolate gives none."""
    rows = spark.read.schema(REPO).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    rows = rows.where(F.lit(not isolate))
    return rows.withColumns({"owner_id": F.coalesce("service_name", "repo_name"), "file": F.input_file_name()})


def rows_of(repos: DataFrame, name: str) -> DataFrame:
    """The nested rows of one kind, with their owner, an ordinal that repeats from run to run, and defaults."""
    out = repos.select("owner_id", "repo_name", "service_name", "file", F.posexplode(name).alias("place", "row")).select(
        "owner_id", "repo_name", "service_name", F.struct("file", "place").alias("ordinal"), "row.*"
    )
    known = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in out.columns}
    return out.withColumns(known) if known else out


def merge_configs(repos: DataFrame) -> Config:
    """The union of all services' declarations: a few names, on the driver."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"config.{c}")))) for c in ("internal_env_vars", "external_env_vars", "internal_domains", "external_domains")]
    return Config(*(tuple(x) for x in repos.agg(*sets).first()))


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of source files below root, without ignored and test directories and test files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "^[a-z]+:/+", "/")
    below = F.substring(base, len(root.rstrip("/")) + 1, 1 << 20)
    folders = F.split(below, "/")
    folders = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    wanted = below.rlike(SOURCES) & ~below.rlike(TEST_FILE) & ~F.exists(folders, lambda d: d.isin(*IGNORED_DIRS) | F.lower(d).isin(*TEST_DIRS))
    return files.where(wanted).select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))  # one bad file doesn't end the job


def provenance_of(path: F.Column) -> F.Column:
    """mock for files in test or mock directories or with a test's ending, else route."""
    dirs = F.split(F.lower(path), "/")
    mock = F.exists(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), lambda d: d.isin(*TEST_DIRS, *MOCK_DIRS)) | path.rlike(TEST_FILE)
    return F.when(mock, "mock").otherwise("route")


def write_projection(frames: dict[str, DataFrame], path: str, order: dict[str, list[str]]) -> None:
    """Each table as JSON lines in a stable order."""
    for name, df in frames.items():
        df.orderBy(*order[name]).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def read_label_file(path: str) -> dict:
    """A label file of the evaluation: small, on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
