"""Evaluation: precision, recall and F1 of sets, means over runs, pass rates, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions.keys import one_blank, scoring_key

BAND = 0.05


def prf(hits: F.Column, found: F.Column, expected: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """(precision, recall, f1): with nothing expected recall is 1, and precision too if nothing was found; finding nothing of what is expected has precision 0."""
    p = F.when(found == 0, F.when(expected == 0, 1.0).otherwise(0.0)).otherwise(hits / found)
    r = F.when(expected == 0, 1.0).otherwise(hits / expected)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def set_scores(found: DataFrame, expected: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, hits, found, expected, precision, recall, f1) of two key sets."""
    a = found.select(*by, *keys).distinct().withColumn("f", F.lit(1))
    b = expected.select(*by, *keys).distinct().withColumn("e", F.lit(1))
    counts = a.join(b, [*by, *keys], "full").groupBy(*by).agg(F.count(F.col("f") + F.col("e")).alias("hits"), F.count("f").alias("found"), F.count("e").alias("expected"))
    p, r, f1 = prf(F.col("hits"), F.col("found"), F.col("expected"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def tiered_scores(found: DataFrame, expected: DataFrame, keys: list[str], default: str = "capability") -> DataFrame:
    """(tier, hits, found, expected, precision, recall, f1) of keys whose tiers only the expectation knows.

    A found key counts for the tiers that expect it; one that no tier expects counts against the default tier.
    """
    labels = expected.select("tier", *keys).distinct()
    claimed = found.select(*keys).distinct().join(labels, keys, "left").withColumn("tier", F.coalesce("tier", F.lit(default)))
    return set_scores(claimed, labels, keys, ["tier"])


EDGE = ["producer_repo", "producer_key", "consumer_repo", "consumer_key"]


def folded(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """edges (EDGE and others) with repositories for the service names that stand for them (aliases: service, repo), and keys in the scorers' form."""
    out = edges
    for side in ("producer", "consumer"):
        name = aliases.select(F.col("service").alias(f"{side}_repo"), F.col("repo").alias("known"))
        out = out.join(name, f"{side}_repo", "left")
        out = out.withColumns({f"{side}_repo": F.coalesce("known", f"{side}_repo"), f"{side}_key": scoring_key(f"{side}_key")}).drop("known")
    return out


def match_scores(found: DataFrame, expected: DataFrame, aliases: DataFrame) -> DataFrame:
    """Precision, recall and F1 of edges by tier, once both sides are folded."""
    return tiered_scores(folded(found, aliases), folded(expected, aliases), EDGE)


def compat_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(tier, correct, total, accuracy) over expected edges with a verdict that were found; 1 if there are none.

    Both are folded. If a verdict is expected but no found edge has any, the check never ran: that ends the job.
    """
    wanted = expected.where("type_compatible is not null")
    silent = found.where("type_compatible is not null").isEmpty() and not wanted.isEmpty()
    if silent:
        raise ValueError("edges are expected to carry type verdicts, but none was found: the type check did not run")
    own = found.groupBy(*EDGE).agg(F.max("type_compatible").alias("seen"), F.lit(True).alias("met"))
    right = F.col("seen").eqNullSafe(F.col("type_compatible"))
    joined = expected.join(own, EDGE, "left").withColumn("scored", F.col("met") & F.col("type_compatible").isNotNull())
    counts = joined.groupBy("tier").agg(F.count_if(F.col("scored") & right).alias("correct"), F.count_if("scored").alias("total"))
    return counts.withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(F.col("correct") / F.col("total")))


def conflict_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of dependency conflicts (package, versions array, severity) by tier; the order of versions doesn't count."""
    keyed = lambda df: df.withColumn("versions", F.array_join(F.array_sort("versions"), ","))
    return tiered_scores(keyed(found), keyed(expected), ["package", "versions", "severity"])


def orphan_scores(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """(tier, hits, expected, precision, recall, f1) of expected orphans (tier, repo, side, key): those that are at no end of an edge."""
    ends = edges.select(F.col("producer_repo").alias("repo"), F.lit("producer").alias("side"), scoring_key("producer_key").alias("key")).unionByName(
        edges.select(F.col("consumer_repo").alias("repo"), F.lit("consumer").alias("side"), scoring_key("consumer_key").alias("key"))
    )
    wanted = expected.select("tier", "repo", "side", scoring_key("key").alias("key")).distinct()
    met = wanted.join(ends.distinct().withColumn("met", F.lit(True)), ["repo", "side", "key"], "left")
    counts = met.groupBy("tier").agg(F.count_if(F.col("met").isNull()).alias("hits"), F.count(F.lit(1)).alias("expected"))
    p, r, f1 = prf(F.col("hits"), F.col("hits"), F.col("expected"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def join_diagnosis(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(labelled, predicted, label_repos, found_repos), one row if both sides have edges but none of them meets (both folded), else none."""
    sides = [df.select(F.lit(side).alias("side"), *EDGE) for side, df in (("label", expected), ("found", found))]
    per_edge = sides[0].unionByName(sides[1]).groupBy(*EDGE).agg(
        F.count_if(F.col("side") == "label").alias("labels"), F.count_if(F.col("side") == "found").alias("founds")
    )
    repos = F.array("producer_repo", "consumer_repo")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col(c) > 0, repos))))), ", ")
    out = per_edge.agg(F.sum("labels").alias("labelled"), F.sum("founds").alias("predicted"), names("labels").alias("label_repos"), names("founds").alias("found_repos"), F.count_if((F.col("labels") > 0) & (F.col("founds") > 0)).alias("joined"))
    return out.where("labelled > 0 and predicted > 0 and joined = 0").drop("joined")


def overall(scores: DataFrame, dimensions: list[str], compat: str, compat_scored: str) -> DataFrame:
    """scores with overall: the mean of the dimensions, and of compat where it was scored."""
    total = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0]))
    extra = F.when(F.col(compat_scored), F.col(compat)).otherwise(0.0)
    return scores.withColumn("overall", (total + extra) / (F.lit(len(dimensions)) + F.col(compat_scored).cast("int")))


def field_accuracy(found: DataFrame, expected: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(correct, total, accuracy) of a field over the keys that both have; nulls are equal, runs of white space count as one blank."""
    a = found.groupBy(*keys).agg(F.min(one_blank(field)).alias("seen"))
    counts = expected.join(a, keys).agg(F.count_if(one_blank(field).eqNullSafe(F.col("seen"))).alias("correct"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(F.col("correct") / F.col("total")))


def call_blend(http: DataFrame, exact_found: DataFrame, exact_expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row of precision, recall and F1 over all calls: HTTP labels met by contains (http: hit, found, expected flags) and exact keys of the other protocols."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    keyed = exact_found.select(*keys).distinct().withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(exact_expected.select(*keys).distinct().withColumns({"a": F.lit(0), "b": F.lit(1)}))
    exact = keyed.groupBy(*keys).agg(F.max("a").alias("found"), F.max("b").alias("expected")).select((F.col("found") * F.col("expected")).alias("hit"), "found", "expected")
    both = http.select(flag("hit").alias("hit"), flag("found").alias("found"), flag("expected").alias("expected")).unionByName(exact)
    counts = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("hit", "hits"), ("found", "found"), ("expected", "expected"))))
    p, r, f1 = prf(F.col("hits"), F.col("found"), F.col("expected"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def mean_sd(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, sd): the sample deviation, 0 for one run."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def pass_rates(runs: DataFrame, by: list[str], element: str, passed: str) -> DataFrame:
    """(by, pass_any, pass_all): shares of elements that any run, and every run, passes."""
    each = runs.groupBy(*by, element).agg(F.bool_or(passed).cast("int").alias("any_run"), F.bool_and(passed).cast("int").alias("all_runs"))
    return each.groupBy(*by).agg(F.avg("any_run").alias("pass_any"), F.avg("all_runs").alias("pass_all"))


def regressions(now: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """(by, regressed): the mean fell by more than the baseline's deviation, or BAND if that is larger."""
    b = baseline.select(*by, F.col("mean").alias("base"), F.col("sd").alias("base_sd"))
    return now.join(b, by).withColumn("regressed", F.col("base") - F.col("mean") > F.greatest("base_sd", F.lit(BAND)))


def label_matches(calls: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_id, n): how many calls carry a label's method, and hold its host and path texts. Labels are few, so each meets all calls of its method."""
    m = F.upper(F.col("method"))
    c = calls.withColumn("m", m).select("m", "target")
    joined = labels.withColumn("m", m).join(c, "m", "left")
    hit = F.col("target").contains(F.coalesce("host_contains", F.lit(""))) & F.col("target").contains(F.coalesce("path_contains", F.lit("")))
    return joined.groupBy("label_id").agg(F.count_if(hit).alias("n"))


def claim(ops: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Ops and labels of one key paired one to one, in the order of their ids."""
    a = ops.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("op_id")))
    b = labels.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("label_id")))
    return a.join(b, [*keys, "place"]).drop("place")


def decoy_leaks(found: DataFrame, decoys: DataFrame) -> DataFrame:
    """Found (method, path) rows that must not be emitted; a decoy's method * stands for all."""
    exact = found.join(decoys.where("method <> '*'"), ["method", "path"], "left_semi")
    return exact.unionByName(found.join(decoys.where("method = '*'").select("path"), "path", "left_semi").select(*found.columns)).distinct()
