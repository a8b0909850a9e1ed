"""Mounts, re-exports, imports and call graphs: fan-out, closures, levels, lattice fixpoints.

Loops write each round to the shared folder through checkpoint(), so plans stay short and lost executors cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import paths
from wirelake.sources.checkpoints import cut, cut_plain

MOST_ROUNDS = 64


def fan_out(endpoints: DataFrame, mounts: DataFrame) -> DataFrame:
    """endpoints with full_path: one row for each distinct prefix that mounts the endpoint's owner node, or its own path."""
    joined = endpoints.join(mounts.select(F.col("child").alias("node"), "path_prefix"), "node", "left")
    full = F.when(F.col("path_prefix").isNull(), F.col("path")).otherwise(paths.join_paths("path_prefix", "path"))
    return joined.withColumn("full_path", full).drop("path_prefix").dropDuplicates(["endpoint_id", "full_path"])


def node_types(mounts: DataFrame) -> DataFrame:
    """(node, node_type): mounted nodes are mountable, nodes that only mount are roots."""
    nodes = mounts.select(F.col("parent").alias("node")).unionByName(mounts.select(F.col("child").alias("node"))).distinct()
    mounted = mounts.select(F.col("child").alias("node")).distinct().withColumn("mounted", F.lit(True))
    return nodes.join(mounted, "node", "left").select("node", F.when(F.col("mounted"), "mountable").otherwise("root").alias("node_type"))


def mount_chains(mounts: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(node, root, prefix, depth): the way from each mounted node to a root; cycles end after most steps without a row."""
    roots = mounts.select(F.col("parent").alias("node")).join(mounts.select(F.col("child").alias("node")), "node", "left_anti").distinct()
    now = roots.select("node", F.col("node").alias("root"), F.lit("").alias("prefix"), F.lit(0).alias("depth"))
    out = None
    for _ in range(most):
        step = mounts.select(F.col("parent").alias("node"), "child", "path_prefix").join(now, "node")
        now = cut(step.select(F.col("child").alias("node"), "root", F.concat("prefix", "path_prefix").alias("prefix"), (F.col("depth") + 1).alias("depth")))
        if now.isEmpty():
            break
        out = now if out is None else out.unionByName(now)
    return now if out is None else out


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): nodes that edges (src, dst) lead to from starts (node), with the fewest steps."""
    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def levels(nodes: DataFrame, calls: DataFrame, most: int | None = None) -> DataFrame:
    """(node, level): callees before callers; what a cycle holds up comes in one last level. calls is (src, dst)."""
    inner = cut(calls.where("src <> dst").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
    left, done, level = cut(nodes.select("node").distinct()), None, 0
    while most is None or level < most:
        waiting = inner.join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = cut(left.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready, "node", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(level))
    return rest if done is None else done.unionByName(rest)


def follow_exports(exports: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """(id, file, name) where an asked (id, file, name) is defined.

    exports: file, name, kind, to_file, to_name, ordinal. A forwarded name beats a local one beats a star; stars never carry default.
    """
    rank = F.when(F.col("kind") == "forward", 0).when(F.col("kind") == "local", 1).otherwise(2)
    now, found = asked.select("id", "file", "name"), None
    for _ in range(most):
        named = now.join(exports.where("kind <> 'star'").withColumn("rank", rank), ["file", "name"])
        star = now.where("name <> 'default'").join(exports.where("kind = 'star'").drop("name").withColumn("rank", rank), "file").withColumn("to_name", F.col("name"))
        both = named.select("id", "file", "name", "kind", "to_file", "to_name", "rank", "ordinal").unionByName(star.select("id", "file", "name", "kind", "to_file", "to_name", "rank", "ordinal"))
        first = Window.partitionBy("id", "file", "name").orderBy("rank")
        best = cut(both.withColumn("r", F.rank().over(first)).where("r = 1"))
        local = best.where("kind = 'local'").select("id", "file", "name")
        found = local if found is None else found.unionByName(local)
        now = cut(best.where("kind <> 'local'").select("id", F.col("to_file").alias("file"), F.col("to_name").alias("name")).distinct())
        if now.isEmpty():
            break
    return found.distinct()


def ownership(facts: DataFrame, flows: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(slot, value): values of facts (slot, value) carried along flows (src, dst) to a fixpoint; slots that two values reach are in conflict (null)."""
    top = F.lit("\u0000conflict")
    state = cut_plain(facts.groupBy("slot").agg(F.when(F.count_distinct("value") > 1, top).otherwise(F.min("value")).alias("value")))
    for _ in range(most):
        moved = flows.join(state.withColumnRenamed("slot", "src"), "src").select(F.col("dst").alias("slot"), "value")
        new = cut_plain(state.unionByName(moved).groupBy("slot").agg(F.when((F.count_distinct("value") > 1) | (F.max("value") == top) | (F.min("value") == top), top).otherwise(F.min("value")).alias("value")))
        same = new.exceptAll(state).isEmpty()
        state = new
        if same:
            break
    return state.select("slot", F.when(F.col("value") != top, F.col("value")).alias("value"))


def longest_prefix(specifiers: DataFrame, packages: DataFrame) -> DataFrame:
    """(specifier, package): the longest package whose name begins the specifier on a segment boundary, by equi-join on its prefixes."""
    parts = F.split("specifier", "/")
    cuts = specifiers.select("specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("package"))
    return cuts.join(packages.select("package").distinct(), "package").groupBy("specifier").agg(F.max_by("package", F.length("package")).alias("package"))
