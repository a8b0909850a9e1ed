"""Type verdicts: outcomes of compiler checks laid over edges, rolled up and combined. Null means never evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.functions import keys, paths

#: Precedence of verdicts: the larger code wins.
CODES = {"compatible": 0, "unverifiable": 1, "incompatible": 2}


def code_of(bucket: F.Column, gate: F.Column | None = None) -> F.Column:
    """The code of an outcome; one that the gate caught on a baked any is unverifiable; null stays null."""
    out = F.lit(None).cast("int")
    for name, code in CODES.items():
        out = F.when(bucket == name, code).otherwise(out)
    return out if gate is None else F.when(gate == "baked_any", CODES["unverifiable"]).otherwise(out)


def verdict_of(code: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for name, c in CODES.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def overlay(edges: DataFrame, outcomes: DataFrame, on: list[str]) -> DataFrame:
    """edges with verdict, compatible and reason. Shared external contracts stay without any.

    outcomes has on, bucket, gate, pair_key and diagnostic; of several the gravest counts, and the first
    incompatible one in order of pair_key gives the reason.
    """
    code = code_of(F.col("bucket"), F.col("gate"))
    best = outcomes.withColumn("code", code).groupBy(*on).agg(
        F.max("code").alias("code"), F.min_by("diagnostic", F.when(F.col("code") == CODES["incompatible"], F.col("pair_key"))).alias("first_reason")
    )
    exempt = F.col("relationship") == "shared_external_contract"
    joined = edges.join(best, on, "left").withColumn("code", F.when(~exempt, F.col("code")))
    compatible = F.when(F.col("code") == CODES["compatible"], True).when(F.col("code") == CODES["incompatible"], False)
    reason = F.when(F.col("code") == CODES["incompatible"], F.col("first_reason"))
    return joined.withColumns({"verdict": verdict_of(F.col("code")), "compatible": compatible, "reason": reason}).drop("code", "first_reason")


def overlay_edges(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """edges (producer_key, location, relationship and others) with verdict, compatible and reason by what was checked.

    outcomes has method, identity, consumer_file, consumer_line, bucket, gate, pair_key and diagnostic. They meet by method, path with parameters as one, and the
    consumer's file and line; line 0 is line 1. Edges without a location, or of protocols that are never checked, have no verdict.
    """
    parsed = keys.verdict_key("producer_key")
    at = {"v_method": parsed["method"], "v_path": paths.compat_path(parsed["identity"]), "v_file": F.when(F.col("location").isNotNull(), keys.file_of("location")), "v_line": F.when(F.col("location").isNotNull(), keys.line_of("location"))}
    checked = outcomes.select(
        F.col("method").alias("v_method"), paths.compat_path("identity").alias("v_path"), F.col("consumer_file").alias("v_file"), F.greatest(F.col("consumer_line").cast("int"), F.lit(1)).alias("v_line"),
        "bucket", "gate", "pair_key", F.coalesce(F.nullif("diagnostic", F.lit("")), F.lit("producer and consumer types are incompatible")).alias("diagnostic"),
    )
    return overlay(edges.withColumns(at), checked, list(at)).drop(*at)


def with_missing_outcomes(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pairs (pair_key) with bucket, gate and diagnostic; a pair that the check returned nothing for is unverifiable."""
    joined = pairs.join(outcomes.select("pair_key", "bucket", "gate", "diagnostic", F.lit(True).alias("checked")), "pair_key", "left")
    said = F.when(F.col("checked"), F.col("diagnostic")).otherwise("the check returned no verdict for this pair")
    return joined.withColumns({"bucket": F.coalesce("bucket", F.lit("unverifiable")), "diagnostic": said}).drop("checked")


def producer_provenance(rows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """rows (method, path) with provenance: that of the endpoints of the same verb and path, parameters as one; a route wins, and none is a route."""
    own = endpoints.groupBy(F.upper("method").alias("v_method"), paths.compat_path("full_path").alias("v_path")).agg(F.min("prov").alias("least"))
    met = rows.withColumns({"v_method": F.upper("method"), "v_path": paths.compat_path("path")}).join(own, ["v_method", "v_path"], "left")
    return met.withColumn("provenance", F.when(F.col("least") == 1, "mock").otherwise("route")).drop("v_method", "v_path", "least")


def roll_up(rows: DataFrame, by: list[str]) -> DataFrame:
    """The gravest verdict for each group."""
    return rows.groupBy(*by).agg(verdict_of(F.max(code_of(F.col("bucket")))).alias("verdict"))


def compat_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, compatible, reason): incompatible if one outcome is; the reason is the first incompatible one's by ordinal."""
    bad = F.col("bucket") == "incompatible"
    judged = rows.where(F.col("bucket").isin("compatible", "incompatible"))
    return judged.groupBy(*by).agg(F.bool_and(~bad).alias("compatible"), F.min_by("diagnostic", F.when(bad, F.col("ordinal"))).alias("reason"))


def direction(role: F.Column, kind: F.Column) -> F.Column:
    """Which side's type must fit the other's: requests flow to the producer, responses and messages to the consumer."""
    return F.when(kind == "request", "consumer_to_producer").when(kind.isin("response", "message"), "producer_to_consumer")


def classify_diagnostics(rows: DataFrame) -> DataFrame:
    """(pair_key, bucket) from (pair_key, diagnostic_code, probe_failed): no diagnostics are compatible; assignability codes incompatible; others unverifiable."""
    # The compiler's codes for a failed assignment.
    assign = F.col("diagnostic_code").isin(2322, 2345, 2739, 2740, 2741)
    return rows.groupBy("pair_key").agg(
        F.when(F.bool_or("probe_failed") | F.bool_or(F.col("diagnostic_code").isNotNull() & ~assign), "unverifiable").when(F.bool_or(F.coalesce(assign, F.lit(False))), "incompatible").otherwise("compatible").alias("bucket")
    )
