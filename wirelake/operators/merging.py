"""The merged graph of all repositories, owners of endpoints, names that files export, operations folded into endpoints and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import paths
from wirelake.operators.findings import first_of
from wirelake.sources.checkpoints import cut

#: Re-exports are followed this far.
MOST_HOPS = 8


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each name."""
    return first_of(nodes, ["name"], "ordinal")


def merged_endpoints(endpoints: DataFrame) -> DataFrame:
    """The first endpoint of each repository, service, method and path; a missing service counts as blank."""
    return first_of(endpoints.withColumn("own", F.coalesce("service_name", F.lit(""))), ["repo_name", "own", "method", "full_path"], "ordinal").drop("own")


def merged_calls(calls: DataFrame, by_repository: bool = False) -> DataFrame:
    """The first call of each method, target and place. Places of different repositories look alike, so by_repository tells them apart."""
    keys = ["method", "target_url", "file_location"]
    return first_of(calls, ["repo_name", *keys] if by_repository else keys, "ordinal")


def merged_mounts(mounts: DataFrame) -> DataFrame:
    return first_of(mounts, ["parent", "child", "path_prefix"], "ordinal")


def endpoint_owners(endpoints: DataFrame, bindings: DataFrame, imports: DataFrame) -> DataFrame:
    """endpoints (id, repo, file, owner) with resolved: the router that the owner's name stands for in its file.

    bindings (repo, file, local_name, child, ordinal): if the file has one, its child; of several the first that bears the owner's name. Without any, the
    longest import pattern (repo, pattern, child) that the file's path contains, if it leads to one child. Else the owner itself.
    """
    named = Window.partitionBy("repo", "file")
    own = bindings.withColumns({"n": F.count(F.lit(1)).over(named), "only": F.min("child").over(named)})
    single = own.where("n = 1").select("repo", "file", F.col("only").alias("single"))
    files = bindings.select("repo", "file").distinct().withColumn("bound", F.lit(True))
    by_name = bindings.groupBy("repo", "file", F.col("local_name").alias("owner")).agg(F.min_by("child", "ordinal").alias("by_name"))
    joined = endpoints.join(files, ["repo", "file"], "left").join(single, ["repo", "file"], "left").join(by_name, ["repo", "file", "owner"], "left")
    loose = endpoints.select("repo", "file").distinct().join(files, ["repo", "file"], "left_anti")
    met = loose.join(imports.select("repo", "pattern", "child"), "repo").where(F.col("file").contains(F.col("pattern")))
    longest = met.withColumn("best", F.max(F.length("pattern")).over(named)).where(F.length("pattern") == F.col("best"))
    agreed = longest.groupBy("repo", "file").agg(F.count_distinct("child").alias("children"), F.min("child").alias("by_import")).where("children = 1").drop("children")
    out = joined.join(agreed, ["repo", "file"], "left")
    resolved = F.when(F.col("bound"), F.coalesce("single", "by_name", "owner")).otherwise(F.coalesce("by_import", "owner"))
    return out.withColumn("resolved", resolved).drop("bound", "single", "by_name", "by_import")


def mount_bindings(mounts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mounts (id, file, child, import_source) with the file and exported name that their child stands for (resolved: file, local, to_file, exported)."""
    names = resolved.select("file", F.col("local").alias("child"), "to_file", "exported")
    return mounts.join(names, ["file", "child"], "left")


def export_names(local: DataFrame, forwarded: DataFrame, stars: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(file, name): what each file exports: its own names (file, name), forwarded ones, and by star (file, to_file) those of others but their default."""
    known = local.select("file", "name").unionByName(forwarded.select("file", "name")).distinct()
    edges = cut(stars.select("file", "to_file").distinct())
    front, all_pairs = edges, edges
    for _ in range(most - 1):
        step = edges.select(F.col("file").alias("to_file"), F.col("to_file").alias("next"))
        front = cut(front.join(step, "to_file").select("file", F.col("next").alias("to_file")).distinct().join(all_pairs, ["file", "to_file"], "left_anti"))
        if front.isEmpty():
            break
        all_pairs = cut(all_pairs.unionByName(front))
    far = all_pairs.where("file <> to_file").join(known.select(F.col("file").alias("to_file"), "name"), "to_file").where("name <> 'default'")
    return known.unionByName(far.select("file", "name")).distinct()


def fold_operations(endpoints: DataFrame, calls: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints, calls) with the operations of other protocols: producers join the endpoints, consumers the calls; pub-sub without a role is dropped.

    All have owner_id, protocol, key and location; ops also role.
    """
    kept = ops.where(F.col("role").isNotNull())
    columns = ["owner_id", "protocol", "key", "location"]
    sides = [kept.where(F.col("role") == role).select(*columns) for role in ("producer", "consumer")]
    return endpoints.select(*columns).unionByName(sides[0]), calls.select(*columns).unionByName(sides[1])


def protocol_manifest(ops: DataFrame) -> DataFrame:
    """(owner_id, key, role, type_kind, call_id) of operations of other protocols: a producer's first row for each key, consumers and publishers by their place."""
    rows = ops.where(F.col("role").isNotNull()).withColumn("type_kind", F.lit("response"))
    by_place = (F.col("role") == "consumer") | (F.col("protocol") == "pubsub") & (F.col("role") == "producer")
    placed = rows.where(by_place).withColumn("call_id", F.col("location"))
    own = first_of(rows.where(~by_place), ["owner_id", "key"], "location").withColumn("call_id", F.lit(None).cast("string"))
    columns = ["owner_id", "key", "role", "type_kind", "call_id"]
    return own.select(*columns).unionByName(placed.select(*columns)).distinct()


def stamp_symbols(manifest: DataFrame, endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """manifest (file, line and others) with the type symbol known at its place: an endpoint's before a call's, the first by ordinal; line 0 is line 1."""
    at = F.greatest(F.col("line"), F.lit(1)).alias("line")
    known = endpoints.select("file", at, "symbol", F.struct(F.lit(0).alias("side"), F.col("ordinal")).alias("rank")).unionByName(
        calls.select("file", at, "symbol", F.struct(F.lit(1).alias("side"), F.col("ordinal")).alias("rank"))
    )
    first = known.where("symbol is not null").groupBy("file", "line").agg(F.min_by("symbol", "rank").alias("stamped"))
    return manifest.join(first, ["file", "line"], "left").withColumn("symbol", F.coalesce("stamped", "symbol")).drop("stamped")


def delta_flags(removed: DataFrame, missing: DataFrame, sdk: DataFrame) -> DataFrame:
    """removed (id, method, path) with still_consumed (a missing-endpoint finding names the route), and packages and consumers that reach it through a client.

    sdk has method, path, package, consumer. Rows meet by verb and number of segments, then segment by segment.
    """
    shaped = lambda df, path: df.withColumns({"verb": F.upper("method"), "size": F.size(paths.segments(path))})
    own = shaped(removed, "path")
    lost = shaped(missing.select("method", F.col("path").alias("other")), "other").drop("method")
    seen = own.join(lost, ["verb", "size"]).where(paths.overlap("path", "other")).select("id").distinct().withColumn("hit", F.lit(True))
    client = shaped(sdk.select("method", F.col("path").alias("other"), "package", "consumer"), "other").drop("method")
    reached = own.join(client, ["verb", "size"]).where(paths.overlap("path", "other")).groupBy("id").agg(F.array_sort(F.collect_set("package")).alias("packages"), F.array_sort(F.collect_set("consumer")).alias("consumers"))
    out = removed.join(seen, "id", "left").join(reached, "id", "left")
    return out.withColumn("still_consumed", F.coalesce("hit", F.lit(False))).drop("hit")


def statistics(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: endpoints, calls, services, and whether any GraphQL operation is there. Both have owner_id and protocol."""
    both = endpoints.select("owner_id", "protocol", F.lit(1).alias("e"), F.lit(0).alias("c")).unionByName(calls.select("owner_id", "protocol", F.lit(0).alias("e"), F.lit(1).alias("c")))
    return both.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("endpoints"), F.coalesce(F.sum("c"), F.lit(0)).alias("calls"), F.count_distinct("owner_id").alias("services"),
        F.coalesce(F.bool_or(F.col("protocol") == "graphql"), F.lit(False)).alias("any_graphql"),
    )


def canonical_order(ops: DataFrame) -> DataFrame:
    """Endpoints or calls in their stable order."""
    return ops.orderBy("key", F.asc_nulls_first("location"))


def observed_fields(endpoints: DataFrame, functions: DataFrame) -> DataFrame:
    """endpoints (key, handler, from_file) with what their imported handler's definition (file, name, response_fields, request_fields) was seen to send and take."""
    known = functions.groupBy(F.col("file").alias("from_file"), F.col("name").alias("handler")).agg(F.min("response_fields").alias("response_fields"), F.min("request_fields").alias("request_fields"))
    return endpoints.join(known, ["from_file", "handler"], "left")


def resolver_locations(ops: DataFrame, claims: DataFrame, handlers: DataFrame) -> DataFrame:
    """GraphQL producers (key) with the place of their resolver: claims (key, file, function, kind) without those that name an HTTP handler of the file.

    A resolver beats a backing type; two different claims of the better kind cancel out.
    """
    open_claims = claims.join(handlers.select("file", F.col("handler").alias("function")).distinct(), ["file", "function"], "left_anti")
    rank = F.when(F.col("kind") == "resolver", 0).otherwise(1)
    best = open_claims.withColumn("rank", rank).withColumn("least", F.min(rank).over(Window.partitionBy("key"))).where("rank = least")
    agreed = best.groupBy("key").agg(F.count_distinct("file", "function").alias("n"), F.min("file").alias("file"), F.min("function").alias("function")).where("n = 1").drop("n")
    return ops.join(agreed, "key", "left")
