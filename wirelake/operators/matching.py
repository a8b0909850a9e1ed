"""Matching consumer calls with producer routes.

The reference rule is a theta join on method and path pattern. Here it becomes equi-joins over distinct (method, path)
pairs: for each pair of masks (which segments of a route and of a call are open) that occurs, all other segments are the
key, and catch-all prefixes meet the call path's own prefixes; the exact agreement is computed on the candidates only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import keys, paths, urls
from wirelake.functions.urls import Config
from wirelake.sources.checkpoints import cut

#: Stand for a first segment that takes any value, and for all first segments.
ANY, ALL = "*", "/"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by hash to tasks for all cores: what follows costs far more than its bytes tell, and would be left to a task or two."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def open_mask(segs: F.Column, wildcard: bool) -> F.Column:
    """A text with 1 for each segment that may take other values: a parameter, or * if wildcard."""

    def mark(raw: F.Column) -> F.Column:
        seg = paths.without_marks(raw)
        return F.when(paths.is_param(seg) | (seg == "*") if wildcard else paths.is_param(seg), "1").otherwise("0")

    return F.array_join(F.transform(segs, mark), "")


def fixed_part(segs: F.Column) -> F.Column:
    """The segments that neither route_mask nor call_mask leaves open, without optional marks."""
    is_open = lambda i: (F.substring("route_mask", i + 1, 1) == "1") | (F.substring("call_mask", i + 1, 1) == "1")
    return F.array_join(F.transform(segs, lambda s, i: F.when(is_open(i), "").otherwise(paths.without_marks(s))), "/")


def candidate_pairs(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(method, full_path, call_path) of distinct pairs that may match; endpoints has method, full_path, calls method, call_path."""
    e = endpoints.select(F.upper("method").alias("method"), "full_path").distinct()
    c = calls.select(F.upper("method").alias("method"), "call_path").distinct()
    segs = paths.segments("full_path")
    required = F.size(F.filter(segs, lambda s: ~s.endswith("?")))
    by_length = e.select("method", "full_path", F.explode(F.sequence(required, F.size(segs))).alias("n")).withColumn("route_mask", open_mask(F.slice(segs, F.lit(1), F.col("n")), True))
    by_length = cut(spread(by_length, *by_length.columns))
    lengths = c.select("method", "call_path", F.size(paths.segments("call_path")).alias("n")).withColumn("call_mask", open_mask(paths.segments("call_path"), False))
    lengths = cut(lengths)
    masks = by_length.select("method", "n", "route_mask").distinct().join(lengths.select("method", "n", "call_mask").distinct(), ["method", "n"])
    masks = cut(masks)
    routes = by_length.join(masks, ["method", "n", "route_mask"]).withColumn("fixed", fixed_part(F.slice(segs, F.lit(1), F.col("n"))))
    asked = lengths.join(masks, ["method", "n", "call_mask"]).withColumn("fixed", fixed_part(paths.segments("call_path")))
    same_length = asked.join(routes, ["method", "n", "route_mask", "call_mask", "fixed"]).select("method", "full_path", "call_path")
    prefixed = e.where(paths.is_catch_all("full_path")).select("method", "full_path", paths.catch_all_prefix("full_path").alias("prefix"))
    cuts = F.transform(F.sequence(F.lit(1), F.size(paths.segments("call_path"))), lambda k: F.array_join(F.slice(paths.segments("call_path"), F.lit(1), k), "/"))
    inside = c.select("method", "call_path", F.explode(cuts).alias("prefix")).join(prefixed, ["method", "prefix"]).select("method", "full_path", "call_path")
    return spread(same_length.unionByName(inside), "method", "full_path", "call_path").distinct()


def best_matches(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(method, call_path, full_path, agreement): for each distinct call the routes of highest agreement, ties kept."""
    scored = candidate_pairs(endpoints, calls).withColumn("agreement", paths.match_agreement("full_path", "call_path"))
    top = Window.partitionBy("method", "call_path").orderBy(F.desc("agreement"))  # nulls come last; a filter before it would compute each agreement twice
    return scored.withColumn("rank", F.rank().over(top)).where("rank = 1 and agreement is not null").drop("rank")


def route_calls(calls: DataFrame, config: Config) -> DataFrame:
    """Valid calls with call_path, display_path, env_var and route_status.

    route_status is external, unresolved or env_undeclared, or null for calls that go on to matching.
    """
    def of(route: F.Column, normal: F.Column, own: F.Column) -> F.Column:
        env = urls.is_env_var_base(route)
        status = (
            F.when(urls.is_declared_call(route, config.external_env, config.external_domains) | own["is_external"], "external")
            .when(normal["is_unresolved"], "unresolved")
            .when(env & ~normal["is_internal"], "env_undeclared")
        )
        return F.struct(route.alias("route"), normal["path"].alias("call_path"), F.when(env, urls.env_var_name(route)).alias("env_var"), status.alias("route_status"))

    # what makes up target_url would be put in each place that reads it
    valid = cut(spread(calls, *calls.columns)).where(urls.is_valid_route_shape(urls.unquoted("target_url")))
    return valid.withColumn("routed", urls.consumer_route("target_url", config, of)).select(*(c for c in calls.columns if c != "method"), F.upper("method").alias("method"), "routed.*")


class HttpMatch:
    """Routed calls and their best routes, computed once for all the results that read them, when the first one does."""

    def __init__(self, endpoints: DataFrame, calls: DataFrame, config: Config):
        self._endpoints, self._calls, self._config = endpoints, calls, config

    @cached_property
    def endpoints(self) -> DataFrame:
        return cut(spread(self._endpoints, *self._endpoints.columns))

    @cached_property
    def routed(self) -> DataFrame:
        return cut(route_calls(self._calls, self._config))

    @property
    def todo(self) -> DataFrame:
        return self.routed.where("route_status is null")

    @cached_property
    def best(self) -> DataFrame:
        return cut(best_matches(self.endpoints, self.todo))

    @property
    def matched(self) -> DataFrame:
        """(method, full_path) that some call matches with agreement over 0, self calls included."""
        return self.best.where("agreement > 0").select("method", "full_path").distinct()


def classified_calls(match: HttpMatch) -> DataFrame:
    """Every valid call with its final route_status: also matched, routed_only (agreement 0), wrong_verb and missing."""
    endpoints, routed, todo = match.endpoints, match.routed, match.todo
    found = match.best.groupBy("method", "call_path").agg(F.max("agreement").alias("agreement"))
    other = endpoints.select(paths.shape_key("full_path").alias("shape")).distinct().withColumn("known", F.lit(True))
    joined = todo.join(found, ["method", "call_path"], "left").withColumn("shape", paths.shape_key("call_path")).join(other, "shape", "left")
    status = F.when(F.col("agreement") > 0, "matched").when(F.col("agreement") == 0, "routed_only").when(F.col("known"), "wrong_verb").otherwise("missing")
    done = joined.withColumn("route_status", status).drop("shape", "known")
    return done.unionByName(routed.where("route_status is not null"), allowMissingColumns=True)


def http_edges(match: HttpMatch) -> DataFrame:
    """One row for each producer route and consumer call of different owners that match with agreement over 0."""
    best = match.best.where("agreement > 0")
    relationship = F.when(F.col("evidence") == "call_site", "shared_external_contract").otherwise("producer_consumer")
    producers = match.endpoints.select(F.upper("method").alias("method"), "full_path", F.col("owner_id").alias("producer"), relationship.alias("relationship")).distinct()
    consumers = match.todo.select("method", "call_path", F.col("owner_id").alias("consumer"), F.col("file_location").alias("location")).distinct()
    pairs = consumers.join(best, ["method", "call_path"]).join(producers, ["method", "full_path"]).where("producer <> consumer")
    # rows differ as the parts they are made of do, but where a | in a method or in both paths lets two keys read the same
    odd = F.col("method").contains("|") | (F.col("full_path").contains("|") & F.col("call_path").contains("|"))
    edges = lambda df: df.select(
        "producer", F.concat_ws("|", F.lit("http"), "method", "full_path").alias("producer_key"),
        "consumer", F.concat_ws("|", F.lit("http"), "method", "call_path").alias("consumer_key"),
        "location", "relationship", "agreement",
    )
    return edges(pairs.where(~odd)).unionByName(edges(pairs.where(odd)).distinct())


def service_dependencies(match: HttpMatch) -> DataFrame:
    """(service, consumer, n_routes): how many distinct (method, call path) of a consumer reach another service."""
    best = match.best.where("agreement > 0")
    producers = match.endpoints.select(F.upper("method").alias("method"), "full_path", F.col("owner_id").alias("service")).distinct()
    reached = best.join(producers, ["method", "full_path"]).select("method", "call_path", "service").distinct()
    consumers = match.todo.select("method", "call_path", F.col("owner_id").alias("consumer")).distinct()
    return consumers.join(reached, ["method", "call_path"]).where("service <> consumer").groupBy("service", "consumer").agg(F.count(F.lit(1)).alias("n_routes"))


def missing_endpoints(match: HttpMatch) -> DataFrame:
    """(method, path, call_sites) of calls that no route takes."""
    lost = classified_calls(match).where("route_status = 'missing'")
    return lost.groupBy("method", F.col("call_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("file_location")), ",").alias("call_sites"))


def method_mismatches(match: HttpMatch) -> DataFrame:
    """(method, path, expected, call_sites): calls whose path exists under another verb.

    Of several producers the first unverified one in order of (verb, path) is expected, else the first; groups
    then form by the producer's declared path.
    """
    wrong = classified_calls(match).where("route_status = 'wrong_verb'").withColumn("shape", paths.shape_key("call_path"))
    verified = match.matched.withColumn("verified", F.lit(1))
    routes = match.endpoints.select(F.upper("method").alias("expected"), "full_path").distinct().withColumn("shape", paths.shape_key("full_path"))
    marked = routes.join(verified.select(F.col("method").alias("expected"), "full_path", "verified"), ["expected", "full_path"], "left")
    chosen = marked.groupBy("shape").agg(F.min(F.struct(F.coalesce("verified", F.lit(0)).alias("v"), "expected", "full_path")).alias("best"))
    return (
        wrong.join(chosen, "shape")
        .groupBy("method", F.col("best.full_path").alias("path"), F.col("best.expected").alias("expected"))
        .agg(F.array_join(F.array_sort(F.collect_set("file_location")), ",").alias("call_sites"))
    )


def verified_endpoints(match: HttpMatch) -> DataFrame:
    """(method, path, provenance): routes that a call reaches; a definition in real code beats one in mocks."""
    own = match.endpoints.where("evidence <> 'call_site'").withColumn("method", F.upper("method"))
    hit = own.join(match.matched, ["method", "full_path"], "left_semi")
    return hit.groupBy("method", F.col("full_path").alias("path")).agg(F.when(F.min("prov") == 0, "route").otherwise("mock").alias("provenance"))


def orphaned_endpoints(match: HttpMatch) -> DataFrame:
    """(service, method, path) of defined routes that nothing calls, without catch-alls, routes without a literal segment and producers named by a verb mismatch."""
    named = method_mismatches(match).select(F.col("expected").alias("method"), F.col("path").alias("full_path"))
    own = match.endpoints.where((F.col("evidence") != "call_site") & ~paths.is_catch_all("full_path") & (paths.literal_specificity("full_path") > 0)).withColumn("method", F.upper("method"))
    left = own.join(match.matched, ["method", "full_path"], "left_anti").join(named, ["method", "full_path"], "left_anti")
    return left.select(F.col("owner_id").alias("service"), "method", F.col("full_path").alias("path")).distinct()


def env_var_calls(match: HttpMatch) -> DataFrame:
    """(env_var, method, path, call_sites) of calls by variables that no service declares."""
    open_calls = match.routed.where("route_status = 'env_undeclared'")
    return open_calls.groupBy("env_var", "method", F.col("call_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("file_location")), ",").alias("call_sites"))


def shared_external_contracts(match: HttpMatch) -> DataFrame:
    """(method, path, repos, n_sites): external routes that two services or more call, known from their call sites."""
    best = match.best.where("agreement > 0")
    sites = match.endpoints.where("evidence = 'call_site'").select(F.upper("method").alias("method"), "full_path", F.col("owner_id").alias("repo"), F.col("file_location").alias("site")).distinct()
    met = best.join(sites.select("method", "full_path").distinct(), ["method", "full_path"])
    callers = match.todo.select("method", "call_path", F.col("owner_id").alias("repo"), F.col("file_location").alias("site")).distinct().join(met, ["method", "call_path"])
    own = sites.join(met.select("method", "full_path").distinct(), ["method", "full_path"], "left_semi")
    both = own.unionByName(callers.select("method", "full_path", "repo", "site"))
    out = both.groupBy("method", F.col("full_path").alias("path")).agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.count_distinct("site").alias("n_sites"))
    return out.where(F.size("repos") >= 2).withColumn("repos", F.array_join("repos", ","))


def exact_key_edges(ops: DataFrame) -> DataFrame:
    """(producer, consumer, key, location, prov) of exact-key protocols: every producer owner with every consumer call of another owner."""
    producers = ops.where("side = 'endpoint'").groupBy("key", F.col("owner_id").alias("producer")).agg(F.min("prov").alias("prov"))
    consumers = ops.where("side = 'call'").select("key", F.col("owner_id").alias("consumer"), F.col("file_location").alias("location")).distinct()
    return consumers.join(producers, "key").where("producer <> consumer")


def self_loop_keys(ops: DataFrame) -> DataFrame:
    """(key, owner_id) of keys that one owner alone has on both sides."""
    sides = ops.groupBy("key").agg(F.collect_set("owner_id").alias("owners"), F.collect_set("side").alias("sides"))
    return sides.where((F.size("owners") == 1) & (F.size("sides") == 2)).select("key", F.element_at("owners", 1).alias("owner_id"))


def type_pairs(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(consumer_id, producer_id, score): a consumer's best-scoring producers of another service and the same type kind, ties kept.

    producers and consumers have id, owner_id, method, kind, path. Distinct paths are normalised once and meet by method, kind,
    number of segments and first segment; only pairs that score are joined with the rows.
    """
    segs = F.split("normal", "/", -1)
    token = F.when(F.get(segs, F.lit(1)) == ":param", ANY).otherwise(F.coalesce(F.get(segs, F.lit(1)), F.lit("")))

    def shapes(df: DataFrame) -> DataFrame:
        return df.select(F.upper("method").alias("method"), "kind", "path").distinct().withColumn("normal", paths.type_match_path("path")).withColumns({"n": F.size(segs), "token": token})

    own = shapes(producers).withColumn("token", F.explode(F.array("token", F.lit(ALL)))).select("method", "kind", "n", "token", F.col("path").alias("producer_path"), F.col("normal").alias("producer_normal"))
    seen = F.when(F.col("token") == ANY, F.array(F.lit(ALL))).otherwise(F.array("token", F.lit(ANY)))
    asked = shapes(consumers).withColumn("token", F.explode(seen)).select("method", "kind", "n", "token", F.col("path").alias("consumer_path"), F.col("normal").alias("consumer_normal"))
    covered = F.forall(F.zip_with(F.split("producer_normal", "/", -1), F.split("consumer_normal", "/", -1), lambda s, t: (s == t) | (s == ":param") | (t == ":param")), lambda ok: ok)
    score = F.when(F.col("producer_path") == F.col("consumer_path"), 100).when(F.col("producer_normal") == F.col("consumer_normal"), 95).when(covered, 90)
    pairs = own.join(asked, ["method", "kind", "n", "token"]).withColumn("score", score).where("score is not null").select("method", "kind", "producer_path", "consumer_path", "score").distinct()
    p, c = (df.select(F.upper("method").alias("method"), "kind", F.col("id").alias(f"{side}_id"), F.col("owner_id").alias(f"{side}_owner"), F.col("path").alias(f"{side}_path")) for side, df in (("producer", producers), ("consumer", consumers)))
    scored = pairs.join(c, ["method", "kind", "consumer_path"]).join(p, ["method", "kind", "producer_path"]).where("producer_owner <> consumer_owner")
    top = Window.partitionBy("consumer_id").orderBy(F.desc("score"))
    return scored.withColumn("rank", F.rank().over(top)).where("rank = 1").select("consumer_id", "producer_id", "score")
