"""Package versions over repositories: merging, conflicts, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import versions


def explode_packages(packages: DataFrame) -> DataFrame:
    """(owner_id, package, spec) of dependencies, dev and peer ones; optional ones never conflict."""
    maps = F.array(*(F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>")) for c in ("dependencies", "dev_dependencies", "peer_dependencies")))
    return packages.select("owner_id", F.explode(F.flatten(maps)).alias("x")).select("owner_id", F.col("x.key").alias("package"), F.col("x.value").alias("spec"))


def merge_highest(pins: DataFrame) -> DataFrame:
    """(owner_id, package, version): the highest version of each; strict versions beat others, which go by text."""
    v = versions.clean_spec("spec")
    best = F.max(F.struct(versions.semver(v).isNotNull().alias("valid"), versions.semver(v).alias("semver"), v.alias("version")))
    return pins.groupBy("owner_id", "package").agg(best.alias("x")).select("owner_id", "package", F.col("x.version").alias("version"))


def conflicts(merged: DataFrame) -> DataFrame:
    """(package, versions, owners, severity, tier) of packages with several versions that differ in major or can't be parsed."""
    v = versions.semver("version")
    rows = merged.withColumn("v", v)
    out = rows.groupBy("package").agg(
        F.array_sort(F.collect_set("version")).alias("versions"),
        F.count_distinct("owner_id").alias("owners"),
        F.count_distinct("v.major").alias("majors"),
        F.count_distinct("v.major", "v.minor").alias("minors"),
        F.count_if(F.col("v").isNull()).alias("unparsed"),
        F.count_distinct(F.when(F.col("v").isNotNull(), F.col("version"))).alias("parsed"),
    )
    severity = F.when(F.col("parsed") < 2, "info").when(F.col("majors") > 1, "critical").when(F.col("minors") > 1, "warning").otherwise("info")
    found = out.where((F.size("versions") > 1) & ((F.col("unparsed") > 0) | (F.col("majors") > 1)))
    return found.select("package", F.array_join("versions", ",").alias("versions"), "owners", severity.alias("severity"), F.when(F.col("majors") > 1, "major").otherwise("unparseable").alias("tier"))


def pinned_versions(merged: DataFrame) -> DataFrame:
    """(package_name, versions): who pins which version of a package, sorted."""
    pin = F.struct(F.col("owner_id").alias("repo"), "version", F.lit("package.json").alias("source"))
    return merged.groupBy(F.col("package").alias("package_name")).agg(F.array_sort(F.collect_list(pin)).alias("versions"))


def overrides(resolved: DataFrame) -> DataFrame:
    """(name, version, target): versions below the highest of their compatibility group (major, or 0.minor, or 0.0.patch)."""
    part = lambda i: F.coalesce(F.get(F.split(F.regexp_replace("version", "[-+].*$", ""), r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    numbered = resolved.select("name", "version", part(0).alias("a"), part(1).alias("b"), part(2).alias("c")).distinct()
    group = F.when(F.col("a") > 0, F.concat_ws(".", "a")).when(F.col("b") > 0, F.concat_ws(".", F.lit("0"), "b")).otherwise(F.concat_ws(".", F.lit("0.0"), "c"))
    top = F.max(F.struct("a", "b", "c", "version")).over(Window.partitionBy("name", group))
    return numbered.withColumn("top", top).where("a < top.a or b < top.b or c < top.c").select("name", "version", F.col("top.version").alias("target"))


def nearest_source(sources: DataFrame) -> DataFrame:
    """(name, version): the nearest lockfile's version, then by the format's rank."""
    return sources.groupBy("name").agg(F.min(F.struct("depth", "format_rank", "version")).alias("x")).select("name", F.col("x.version").alias("version"))
