"""Rows around the analysis: captured types and their repair, candidates, socket roots, stub files, messages, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import keys
from wirelake.operators.findings import capped
from wirelake.operators.graphs import reachable

# Texts that declare something and so can't stand for a type, GraphQL packages, bytes of a payload, SDK members of a package and their depth.
DECLARATIONS = r"^(interface|class|enum|namespace|declare|export|abstract|function) "
GRAPHQL_PACKAGES = ("graphql", "graphql-request", "graphql-tag", "relay-runtime", "urql", "apollo-client", "apollo-server")
# Events of the socket library itself.
RESERVED_EVENTS = (
    "connection", "connect", "connect_error", "disconnect", "disconnecting", "error", "reconnect", "reconnect_attempt", "reconnect_error", "reconnect_failed", "ping", "pong", "newListener", "removeListener",
)
PAYLOAD_BYTES, MOST_MEMBERS, MOST_DEPTH = 5 << 20, 20_000, 4
CACHES = ("file_results", "cached_detection", "cached_guidance")


def backfill_texts(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """(alias, text): a literal type for each alias: the first usable explicit one (alias, text, ordinal), else the first usable inferred one.

    Blank texts, declarations and texts that hold any or unknown are no use.
    """
    both = explicit.select("alias", "text", F.lit(0).alias("source"), "ordinal").unionByName(inferred.select("alias", "text", F.lit(1).alias("source"), "ordinal"))
    usable = both.withColumn("text", F.trim("text")).where((F.col("text") != "") & ~F.col("text").rlike(DECLARATIONS) & ~keys.normalised_top_type("text"))
    return usable.groupBy("alias").agg(F.min_by("text", F.struct("source", "ordinal")).alias("text"))


def backfilled_anchors(anchors: DataFrame, records: DataFrame, texts: DataFrame) -> DataFrame:
    """anchors (alias, kind, text, origin) with literal ones in place of those whose record (alias, failure, anchor_kind) tells of a demotion, where a text is known."""
    failed = records.where("failure is not null and anchor_kind <> 'literal'").select("alias").distinct()
    known = texts.join(failed, "alias").select("alias", F.col("text").alias("new_text"))
    joined = anchors.join(known, "alias", "left")
    again = F.col("new_text").isNotNull()
    return joined.withColumns(
        {"kind": F.when(again, "literal").otherwise(F.col("kind")), "text": F.coalesce("new_text", "text"), "origin": F.when(again, "anchor-backfill").otherwise(F.col("origin"))}
    ).drop("new_text")


def backfill_accepted(wanted: DataFrame, first: DataFrame, again: DataFrame) -> DataFrame:
    """One row (accepted): every backfilled alias came out clean, and no other one got worse.

    first and again have alias, failure, self_check, top (boolean) and deep. A usable self-check is ok or allowlisted_external.
    """
    usable = lambda c: c.isin("ok", "allowlisted_external")
    b = again.select("alias", *(F.col(c).alias(f"b_{c}") for c in ("failure", "self_check", "top", "deep")), F.lit(True).alias("met"))
    joined = first.join(wanted.select("alias", F.lit(True).alias("backfilled")), "alias", "left").join(b, "alias", "left")
    clean = F.col("b_failure").isNull() & (F.col("b_self_check") == "ok") & ~F.col("b_top") & F.col("b_deep").isNull()
    worse = (
        (usable(F.col("self_check")) & ~usable(F.col("b_self_check")))
        | (F.col("failure").isNull() & F.col("b_failure").isNotNull())
        | (F.col("deep").isNull() & F.col("b_deep").isNotNull())
        | (~F.col("top") & F.col("b_top"))
    )
    fine = F.coalesce(F.col("met"), F.lit(False)) & F.when(F.col("backfilled"), clean).otherwise(~worse)
    lost = wanted.join(first, "alias", "left_anti").join(b.where("b_failure is null and b_self_check = 'ok' and not b_top and b_deep is null"), "alias", "left_anti").select(F.lit(False).alias("fine"))
    return joined.select(F.coalesce(fine, F.lit(False)).alias("fine")).unionByName(lost).agg(F.coalesce(F.bool_and("fine"), F.lit(True)).alias("accepted"))


def with_candidates(endpoints: DataFrame, calls: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints, calls) with line and span of their candidate (candidate_id, at, span): endpoints without one go, calls stay as they are."""
    met = endpoints.drop("line").join(candidates.select("candidate_id", F.col("at").alias("line"), "span"), "candidate_id")
    kept = calls.join(candidates.select("candidate_id", "at", "span"), "candidate_id", "left")
    return met, kept.withColumn("line", F.coalesce("at", "line")).drop("at")


def without_borrowed_types(calls: DataFrame, bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """calls (id, file, symbol, payload, text) whose symbol is only the declared type of what they send lose it.

    bindings (file, name, type) are declared variables, evidence (file, type) types that answers are annotated with; a type argument of the call is evidence too.
    """
    own = bindings.groupBy("file", F.col("name").alias("payload")).agg(F.min("type").alias("declared"))
    seen = evidence.select("file", F.col("type").alias("symbol")).distinct().withColumn("answered", F.lit(True))
    joined = calls.join(own, ["file", "payload"], "left").join(seen, ["file", "symbol"], "left")
    generic = F.coalesce(F.regexp_like("text", F.concat(F.lit(r"<[^()]*\b"), F.col("symbol"), F.lit(r"\b[^()]*>\s*\("))), F.lit(False))
    borrowed = (F.col("declared") == F.col("symbol")) & F.col("answered").isNull() & ~generic
    return joined.withColumn("symbol", F.when(~F.coalesce(borrowed, F.lit(False)), F.col("symbol"))).drop("declared", "answered")


def socket_operations(facts: DataFrame, roots: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file, event, direction, side) of calls on sockets: facts (file, root, method, event), roots (file, name, side, namespaced), bindings (file, name, from_name).

    A name bound to a root, directly or through others, is of its side. Clients listen to what servers send and send what servers listen to. Files with custom
    namespaces give nothing, nor do the library's own events.
    """
    place = lambda name: F.concat_ws("\0", "file", name)
    edges = bindings.select(place("from_name").alias("src"), place("name").alias("dst")).distinct()
    spaced = roots.where("namespaced").select("file").distinct()
    sides = None
    for side in ("client", "server"):
        found = reachable(edges, roots.where(F.col("side") == side).select(place("name").alias("node"))).select(F.col("node"), F.lit(side).alias("side"))
        sides = found if sides is None else sides.unionByName(found)
    ops = facts.join(spaced, "file", "left_anti").withColumn("node", place("root")).join(sides.distinct(), "node")
    listens = F.col("method").isin("on", "once")
    sends = F.col("method") == "emit"
    direction = F.when((F.col("side") == "client") == listens, "server_to_client").otherwise("client_to_server")
    own = F.col("event").isin(*RESERVED_EVENTS)
    return ops.where((listens | sends) & ~own).select("file", "event", direction.alias("direction"), F.when(listens, "listener").otherwise("emitter").alias("side")).distinct()


def stub_maps(files: DataFrame) -> DataFrame:
    """(artifact, files): the map of each artifact's files (artifact, path, content), without node_modules."""
    kept = files.where(~F.array_contains(F.split("path", "/"), "node_modules"))
    return kept.groupBy("artifact").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "content")))).alias("files"))


def stub_files(maps: DataFrame) -> DataFrame:
    return maps.select("artifact", F.explode("files").alias("path", "content"))


def graphql_packages(packages: DataFrame) -> DataFrame:
    """The packages (name) that speak GraphQL."""
    low = F.lower("name")
    return packages.where(low.isin(*GRAPHQL_PACKAGES) | low.startswith("@apollo/") | low.startswith("@urql/"))


def raw_targets(calls: DataFrame) -> DataFrame:
    """(key, location, target): each call's target as written, by its key and place; the last of several by ordinal."""
    key = F.concat_ws("|", F.lit("http"), F.upper("method"), "canonical_path")
    return calls.groupBy(key.alias("key"), F.col("file_location").alias("location")).agg(F.max_by("target_url", "ordinal").alias("target"))


def relative_places(rows: DataFrame, columns: list[str], root: Column) -> DataFrame:
    """rows with the columns' places below the repository's root."""
    return rows.withColumns({c: keys.repo_relative(c, root) for c in columns})


ALIAS = r"(Endpoint_[0-9a-f]{16}_(?:Request|Response)(?:_Call[0-9a-f]{16})?)"


def readable(messages: DataFrame, names: DataFrame) -> DataFrame:
    """messages (id, text) with display names (alias, display) for aliases, Array<T> as T[]."""
    asked = messages.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ALIAS), 1))).alias("alias"))
    found = asked.join(names.groupBy("alias").agg(F.min("display").alias("display")), "alias")
    pairs = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.length("alias").alias("n"), "alias", "display"))).alias("pairs"))
    # longer aliases first: a call site's alias begins with another
    shown = F.aggregate(F.reverse("pairs"), F.col("text"), lambda text, p: F.replace(text, p["alias"], p["display"]))
    text = F.when(F.col("pairs").isNotNull(), shown).otherwise(F.col("text"))
    return messages.join(pairs, "id", "left").select("id", F.regexp_replace(text, r"Array<([^<>]+)>", "$1[]").alias("text"))


def within_limit(rows: DataFrame, most: int = PAYLOAD_BYTES) -> DataFrame:
    """rows whose document would be larger than the limit lose their caches."""
    large = F.octet_length(F.to_json(F.struct("*"))) > most
    return rows.withColumns({c: F.when(~large, F.col(c)) for c in CACHES if c in rows.columns})


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges once each, in their stable order: producer and key, consumer and key, place (none first), then relationship."""
    rank = F.when(F.col("relationship") == "producer_consumer", 0).otherwise(1)
    identity = ["producer", "producer_key", "consumer", "consumer_key", "location", "relationship"]
    return edges.dropDuplicates(identity).orderBy("producer", "producer_key", "consumer", "consumer_key", F.asc_nulls_first("location"), rank)


def capped_members(members: DataFrame) -> DataFrame:
    """Published members (owner_id, export, chain) as deep as MOST_DEPTH, the first MOST_MEMBERS of each package."""
    deep = members.where(F.size(F.split("chain", r"\.")) <= MOST_DEPTH)
    return capped(deep, ["owner_id"], ["export", "chain"], MOST_MEMBERS)


def result_payload(sent: DataFrame, verified: DataFrame, statistics: DataFrame, repo: str) -> DataFrame:
    """One row (payload): the result as sent. sent has the findings' payloads with section and place; statistics is one row."""
    findings = sent.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "payload"))), lambda x: x["payload"]), ",").alias("findings"))
    routes = verified.agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("method", "path", "provenance")))), ",").alias("verified"))
    stats = statistics.select(F.to_json(F.struct("endpoints", "calls")).alias("stats"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  three rows of one line each
    joined = one(findings).join(one(routes), "one").join(one(stats), "one")
    return joined.select(F.format_string('{"repo":"%s","stats":%s,"findings":[%s],"verified":[%s]}', F.lit(repo), "stats", "findings", "verified").alias("payload"))
