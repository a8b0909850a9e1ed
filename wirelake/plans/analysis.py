"""The whole cross-service analysis as lazily evaluated tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.functions import keys
from wirelake.functions.urls import Config
from wirelake.operators import dependencies, findings, matching, verdicts


@dataclass
class Analysis:
    edges: DataFrame
    verified: DataFrame
    findings: DataFrame
    conflicts: DataFrame


def listed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with joined texts as arrays."""
    return rows.withColumns({c: F.split(c, ",") for c in columns})


def type_mismatches(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(method, path, call_sites, detail, provenance) of the routes and keys with an incompatible caller; the first reason by place."""
    bad = edges.where("verdict = 'incompatible'").withColumn("shown", keys.display_labels("producer_key"))
    rows = bad.groupBy(F.col("shown.label").alias("method"), F.col("shown.name").alias("path")).agg(
        F.array_sort(F.collect_set("location")).alias("call_sites"), F.min_by("reason", F.struct("location", "consumer_key")).alias("detail")
    )
    return verdicts.producer_provenance(rows, endpoints)


def analyse(endpoints: DataFrame, calls: DataFrame, ops: DataFrame, pins: DataFrame, outcomes: DataFrame, config: Config) -> Analysis:
    """Edges with verdicts, verified routes, findings and version conflicts of all services.

    outcomes has method, identity, consumer_file, consumer_line, bucket, gate, pair_key and diagnostic.
    """
    match = matching.HttpMatch(endpoints, calls, config)
    http = matching.http_edges(match)
    exact = matching.exact_key_edges(ops).select("producer", F.col("key").alias("producer_key"), "consumer", F.col("key").alias("consumer_key"), "location", F.lit("producer_consumer").alias("relationship"))
    edges = verdicts.overlay_edges(http.drop("agreement").unionByName(exact), outcomes)
    merged = dependencies.merge_highest(pins)
    conflicts = dependencies.conflicts(merged)
    rows = findings.all_findings(
        {
            "type_mismatch": type_mismatches(edges, endpoints),
            "method_mismatch": listed(matching.method_mismatches(match), "call_sites").withColumnRenamed("expected", "expected_method"),
            "missing_endpoint": listed(matching.missing_endpoints(match), "call_sites"),
            "orphaned_endpoint": verdicts.producer_provenance(matching.orphaned_endpoints(match), endpoints),
            "env_var_call": listed(matching.env_var_calls(match), "call_sites"),
            "shared_external_contract": listed(matching.shared_external_contracts(match), "repos"),
            "dependency_conflict": conflicts.select(F.col("package").alias("package_name"), "tier").join(dependencies.pinned_versions(merged), "package_name"),
        }
    )
    return Analysis(edges, matching.verified_endpoints(match), rows, conflicts)
