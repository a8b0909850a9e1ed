"""Calls through published client packages: candidate, unique publisher, member, calls inside the member's lines, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def publishers(packages: DataFrame) -> DataFrame:
    """(package, publisher) of packages that exactly one owner publishes."""
    return packages.groupBy(F.col("name").alias("package")).agg(F.count_distinct("owner_id").alias("n"), F.min("owner_id").alias("publisher")).where("n = 1").drop("n")


def chain_of(callee: F.Column) -> F.Column:
    """The members after the receiver; null if an inner one is a call."""
    parts = F.split(callee, r"\.")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(~F.exists(inner, lambda p: p.contains("(")), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "."))


def resolve(candidates: DataFrame, packages: DataFrame, members: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): each candidate's producers, or the first step that fails.

    candidates: id, consumer, package, import_symbol, subpath, callee. members: owner_id, export, chain, file, line, end_line.
    calls: owner_id, file, line, producer: matched calls of publishers. The line range is tested on rows that meet by owner and file.
    """
    found = candidates.withColumn("chain", chain_of(F.col("callee"))).join(publishers(packages), "package", "left")
    member = members.select(F.col("owner_id").alias("publisher"), F.col("export").alias("import_symbol"), "chain", "file", "line", "end_line")
    name = ["publisher", "import_symbol", "chain"]
    named = found.join(member.select(*name).distinct().withColumn("member", F.lit(True)), name, "left")
    inside = calls.select(F.col("owner_id").alias("publisher"), "file", F.col("line").alias("at"), "producer").distinct()
    # what a member reaches is found once for the member, not for each of its callers
    reached = member.join(inside, ["publisher", "file"]).where("at between line and end_line").select(*name, "producer").distinct()
    spans = found.join(reached, name).select("id", "producer").distinct()
    steps = named.join(spans.select("id").distinct().withColumn("linked", F.lit(True)), "id", "left")
    reason = (
        F.when(F.col("publisher").isNull(), "no_sdk_repo_in_project")
        .when(F.col("import_symbol").isNull(), "receiver_unresolved")
        .when(F.col("subpath").isNotNull(), "member_not_found")
        .when(F.col("chain").isNull(), "receiver_unresolved")
        .when((F.col("chain") == "") | F.col("member").isNull(), "member_not_found")
        .when(F.col("linked").isNull(), "no_matching_producer")
    )
    reasoned = steps.withColumn("reason", reason).dropDuplicates(["id"])
    edges = reasoned.where("reason is null").select("id", "consumer", "package", "publisher").join(spans, "id")
    unresolved = reasoned.where("reason is not null").groupBy("consumer", "package", "reason").agg(F.count(F.lit(1)).alias("n"))
    return edges, unresolved


def nearest_records(ops: DataFrame, records: DataFrame) -> DataFrame:
    """(id, record): for each op the record of its key and role in the same file if there is one there, nearest by line, then by ordinal.

    ops: id, key, role, file, line. records: record, key, role, file, line, tier.
    """
    r = records.select("key", "role", F.col("file").alias("record_file"), F.col("line").alias("record_line"), "record", "tier")
    joined = ops.join(r, ["key", "role"]).withColumn("away", (F.col("file") != F.col("record_file")).cast("int"))
    order = Window.partitionBy("id").orderBy("away", "tier", F.abs(F.col("line") - F.col("record_line")), "record")
    return joined.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("id", "record")
