"""The query surface: what an agent asks of the index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_projects(repos: DataFrame) -> DataFrame:
    return repos.select("repo_name").distinct()


def list_services(repos: DataFrame) -> DataFrame:
    return repos.select("repo_name", F.coalesce("service_name", "repo_name").alias("service")).distinct()


def list_function_intents(functions: DataFrame, service: str) -> DataFrame:
    return functions.where((F.col("owner_id") == service) & F.col("intent").isNotNull()).select("name", "file_path", "intent")


def get_api_endpoints(endpoints: DataFrame, service: str) -> DataFrame:
    return endpoints.where(F.col("owner_id") == service).select("method", "full_path", "file_location")


def get_endpoint_types(manifest: DataFrame, key: str) -> DataFrame:
    return manifest.where(F.col("key") == key).select("role", "type_kind", "type_alias", "resolved_definition")


def get_type_definition(manifest: DataFrame, alias: str) -> DataFrame:
    return manifest.where(F.col("type_alias") == alias).select("owner_id", F.coalesce("expanded_definition", "resolved_definition").alias("definition"))


def get_service_dependencies(edges: DataFrame, service: str) -> DataFrame:
    """Who depends on the service: the edges that it produces."""
    return edges.where(F.col("producer") == service)


def check_compatibility(verdicts: DataFrame, producer: str, consumer: str) -> DataFrame:
    return verdicts.where((F.col("producer") == producer) & (F.col("consumer") == consumer))


def search_by_intent(functions: DataFrame, text: str, top: int = 20, id_col: str = "name") -> DataFrame:
    """The rows whose intent holds most of the text's words: a top-k report, ties by id."""
    terms = sorted(set(re.findall("[a-z]+", text.lower())))
    words = F.split(F.lower(F.coalesce("intent", F.lit(""))), "[^a-z]+")
    score = F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))
    return functions.select(id_col, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(top)
