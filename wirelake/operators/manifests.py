"""Operations and type manifests of one service: building rows, folding doubles, choosing anchors, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import paths
from wirelake.operators.findings import first_of

BODILESS = ("GET", "HEAD", "OPTIONS")


def twins(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Endpoints with evidence call_site where a call at the same place has the same method and a matching path."""
    c = calls.select("file_location", F.upper("method").alias("m"), F.col("path").alias("call_path"))
    e = endpoints.withColumn("m", F.upper("method"))
    hit = e.join(c, ["file_location", "m"]).where(paths.paths_match("full_path", "call_path")).select("ordinal").distinct().withColumn("twin", F.lit(True))
    return endpoints.join(hit, "ordinal", "left").withColumn("evidence", F.when(F.col("twin"), "call_site").otherwise(F.col("evidence"))).drop("twin")


def without_echoes(calls: DataFrame) -> DataFrame:
    """Calls without those of wrappers: not anchored, while another call of the same method and path is."""
    anchored = calls.where("anchored").select("method", "path").distinct()
    return calls.where("anchored").unionByName(calls.where("not anchored").join(anchored, ["method", "path"], "left_anti"))


def without_self_calls(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that match no route of their own service with agreement over 0."""
    own = endpoints.select("owner_id", F.upper("method").alias("m"), "full_path").distinct()
    hit = calls.withColumn("m", F.upper("method")).join(own, ["owner_id", "m"]).where(paths.match_agreement("full_path", "path") > 0).select("call_id").distinct()
    return calls.join(hit, "call_id", "left_anti")


def fold_transport(calls: DataFrame, graphql: DataFrame) -> DataFrame:
    """Calls without templates and absolute URLs in files that consume GraphQL."""
    files = graphql.where("side = 'call'").select("file").distinct().withColumn("gql", F.lit(True))
    return calls.join(files, "file", "left").where(F.col("gql").isNull() | ~(F.col("target_url").contains("${") | F.col("target_url").rlike("^https?://"))).drop("gql")


def fold_sockets(pubsub: DataFrame, sockets: DataFrame) -> DataFrame:
    """Pub-sub ops without those that a socket op of the same file and event repeats."""
    return pubsub.join(sockets.select("file", F.col("event").alias("topic")).distinct(), ["file", "topic"], "left_anti")


def manifest_rows(ops: DataFrame) -> DataFrame:
    """(key, role, type_kind, infer_kind, ordinal): a request and a response row for each op, without requests of bodiless producers and rows of call-site producers."""
    rows = ops.where(F.col("path").startswith("/") & ~((F.col("role") == "producer") & (F.col("evidence") == "call_site")))
    both = rows.withColumn("type_kind", F.explode(F.array(F.lit("request"), F.lit("response"))))
    kept = both.where(~((F.col("role") == "producer") & (F.col("type_kind") == "request") & F.upper("method").isin(*BODILESS)))
    keyed = kept.withColumn("key", F.concat_ws("|", F.lit("http"), F.upper("method"), "path"))
    producers = first_of(keyed.where("role = 'producer'"), ["owner_id", "key", "type_kind"], "ordinal")
    infer = F.when((F.col("role") == "producer") & (F.col("type_kind") == "request"), "request_body").when(F.col("role") == "producer", "response_body").when(F.col("type_kind") == "request", "call_payload").otherwise("call_result")
    return producers.unionByName(keyed.where("role = 'consumer'")).withColumn("infer_kind", infer)


def anchors(rows: DataFrame) -> DataFrame:
    """One anchor for each alias: an explicit symbol, else a literal text, else a place, else an inline one."""
    rank = F.when(F.col("symbol").isNotNull(), 0).when(F.col("literal").isNotNull(), 1).when(F.col("line").isNotNull(), 2).otherwise(3)
    order = Window.partitionBy("alias").orderBy(rank, "ordinal")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def fill_missing(manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """(alias, text): a marked placeholder for each alias that the bundle doesn't declare."""
    return manifest.select("alias").distinct().join(declared, "alias", "left_anti").withColumn("text", F.concat(F.lit("export type "), "alias", F.lit(" = unknown; /* missing */")))


def unique_claims(claims: DataFrame) -> DataFrame:
    """Claims of keys with one claim only: two different ones cancel out."""
    return claims.groupBy("key").agg(F.count_distinct("file", "function").alias("n"), F.min("file").alias("file"), F.min("function").alias("function")).where("n = 1").drop("n")


def better_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt with more rows for each file; the later one wins ties."""
    return attempts.groupBy("file").agg(F.max(F.struct("rows", "attempt")).alias("x")).select("file", F.col("x.rows").alias("rows"), F.col("x.attempt").alias("attempt"))


def add_missing(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """base, and the rows of more whose key it doesn't have."""
    return base.unionByName(more.join(base.select(*keys).distinct(), keys, "left_anti"))
