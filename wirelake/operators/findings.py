"""Findings: one sparse table over all kinds, with severity, tier and order; deduplication of index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import keys

# The order of sections, and severities by kind.
ORDER = ("type_mismatch", "method_mismatch", "missing_endpoint", "orphaned_endpoint", "env_var_call", "shared_external_contract", "dependency_conflict")
#: Fields of a finding, and those that each kind has, in the wire's order.
FIELDS = {
    "method": "string", "path": "string", "service": "string", "call_sites": "array<string>", "producer_type": "string", "consumer_type": "string", "detail": "string", "provenance": "string",
    "expected_method": "string", "env_var": "string", "package_name": "string", "tier": "string", "versions": "array<struct<repo:string,version:string,source:string>>", "repos": "array<string>",
}
KIND_FIELDS = {
    "type_mismatch": ("method", "path", "service", "call_sites", "producer_type", "consumer_type", "detail", "provenance"),
    "method_mismatch": ("method", "path", "service", "call_sites", "expected_method"),
    "missing_endpoint": ("method", "path", "service", "call_sites"),
    "orphaned_endpoint": ("method", "path", "service", "provenance"),
    "env_var_call": ("method", "path", "env_var", "call_sites"),
    "shared_external_contract": ("method", "path", "repos", "call_sites"),
    "dependency_conflict": ("package_name", "tier", "versions"),
}
RISKS, GAPS = ("type_mismatch", "method_mismatch"), ("missing_endpoint", "orphaned_endpoint")
WIRE_SITES, DETAIL_CHARS = 5, 400


def severity(kind: F.Column, tier: F.Column) -> F.Column:
    """Fixed for each kind; a dependency conflict is a gap if the majors differ."""
    gap = kind.isin(*GAPS) | ((kind == "dependency_conflict") & F.coalesce(tier == "major", F.lit(False)))
    return F.when(kind.isin(*RISKS), "risk").when(gap, "gap").otherwise("advisory")


def finding_rows(kind: str, rows: DataFrame) -> DataFrame:
    """rows as findings of the kind: its own fields, others null, details cut to DETAIL_CHARS. Missing provenance is route."""
    out = []
    for name, kind_of in FIELDS.items():
        if name in KIND_FIELDS[kind] and name in rows.columns:
            value = keys.truncated(name, DETAIL_CHARS) if name == "detail" else F.col(name).cast(kind_of)
        else:
            value = F.lit("route" if name == "provenance" and name in KIND_FIELDS[kind] else None).cast(kind_of)
        out.append(value.alias(name))
    return rows.select(F.lit(kind).alias("kind"), F.lit(ORDER.index(kind)).alias("section"), *out)


def union_findings(frames: dict[str, DataFrame]) -> DataFrame:
    """All findings with kind, ordinal of the section and severity, without repeated rows."""
    out = None
    for kind in ORDER:
        if kind in frames:
            rows = frames[kind].withColumns({"kind": F.lit(kind), "section": F.lit(ORDER.index(kind))})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out = out.distinct()
    tier = F.col("tier") if "tier" in out.columns else F.lit(None).cast("string")
    return out.withColumn("severity", severity(F.col("kind"), tier))


def all_findings(frames: dict[str, DataFrame]) -> DataFrame:
    """Findings of all kinds in one shape, each once, with severity. Arrays are sorted sets; section gives their order."""
    out = None
    for kind in ORDER:
        if kind in frames:
            rows = finding_rows(kind, frames[kind])
            out = rows if out is None else out.unionByName(rows)
    return out.distinct().withColumn("severity", severity(F.col("kind"), F.col("tier")))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the report's order: sections, then path, method and what else tells them apart."""
    return findings.orderBy("section", F.asc_nulls_first("path"), F.asc_nulls_first("method"), F.asc_nulls_first("service"), F.asc_nulls_first("env_var"), F.asc_nulls_first("package_name"))


def wire(findings: DataFrame) -> DataFrame:
    """(kind, severity, payload): each finding as sent, a JSON object of its kind's fields with the first WIRE_SITES call sites."""
    payload = F.lit(None).cast("string")
    for kind in ORDER:
        fields = [(F.slice(name, 1, WIRE_SITES) if name == "call_sites" else F.col(name)).alias("producer_provenance" if kind == "type_mismatch" and name == "provenance" else name) for name in KIND_FIELDS[kind]]
        body = F.to_json(F.struct(F.col("kind"), F.col("severity"), *fields), {"ignoreNullFields": "false"})
        payload = F.when(F.col("kind") == kind, body).otherwise(payload)
    return findings.select("kind", "severity", payload.alias("payload"))


def categories(findings: DataFrame) -> DataFrame:
    """One row: how many risks, gaps in connectivity, major and other dependency conflicts, and advisories there are."""
    dep = F.col("kind") == "dependency_conflict"
    return findings.agg(
        F.count_if(F.col("kind").isin(*RISKS)).alias("risks"),
        F.count_if(F.col("kind").isin(*GAPS)).alias("connectivity"),
        F.count_if(dep & (F.col("tier") == "major")).alias("major_dependencies"),
        F.count_if(dep & (F.col("tier") != "major")).alias("unparseable_dependencies"),
        F.count_if(F.col("kind") == "env_var_call").alias("configuration"),
        F.count_if(F.col("kind") == "shared_external_contract").alias("shared_contracts"),
    )


def issues(counted: DataFrame, has_baseline: bool) -> DataFrame:
    """categories() with the number of the report's title: risks, major conflicts, and gaps in connectivity only against a baseline."""
    gaps = F.col("connectivity") if has_baseline else F.lit(0)
    return counted.withColumn("issues", (F.col("risks") + gaps + F.col("major_dependencies")).cast("long"))


def env_suggestions(findings: DataFrame) -> DataFrame:
    """(env_var, method, path, locations) of the undeclared variables: all call sites of each, sorted."""
    rows = findings.where("kind = 'env_var_call'").select("env_var", "method", "path", F.explode_outer("call_sites").alias("site"))
    return rows.groupBy("env_var", "method", "path").agg(F.array_sort(F.collect_set("site")).alias("locations"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def first_of(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by ordinal."""
    order = Window.partitionBy(*keys).orderBy(ordinal)
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def capped(rows: DataFrame, by: list[str], order: list[str], most: int = 20_000) -> DataFrame:
    """The first rows of each service in order: a cap of the wire format."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most).drop("rank")
