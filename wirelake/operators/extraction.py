"""What extractors deliver, made into index rows: gates, sanitation, egress, aliases over files, compiler diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import keys, urls
from wirelake.functions.urls import Config
from wirelake.operators.findings import capped
from wirelake.operators.graphs import reachable
from wirelake.sources.index import provenance_of

# Texts that stand for null, packages that talk to networks, names of calls that send and receive.
NULL_LIKE = ("", "null", "none", "undefined", "n/a")
NETWORK_PACKAGES = ("axios", "got", "ky", "node-fetch", "superagent", "undici", "request")
SENDERS = ("publish", "emit", "send", "produce")
RECEIVERS = ("subscribe", "on", "consume")
CLIENT_NAMES = r"(?i)(client|api|http|request|fetch)"
EGRESS_CAP = 20_000


def endpoint_rows(facts: DataFrame) -> DataFrame:
    """Endpoints of HTTP methods, with provenance by their file and a location."""
    return facts.where(keys.is_http_method("method")).withColumns(
        {"method": keys.canonical_method("method"), "provenance": provenance_of(F.col("file")), "file_location": F.concat_ws(":", "file", F.greatest(F.col("line"), F.lit(1)))}
    )


def call_rows(facts: DataFrame, config: Config) -> DataFrame:
    """Calls with a usable method, target and canonical path, and their literal host."""
    rows = facts.withColumn("method", keys.consumer_method("method")).where(F.col("method").isNotNull() & (F.col("line") > 0))
    valid = rows.where(urls.is_valid_route_shape(urls.unquoted("target_url"))).withColumn("canonical_path", urls.consumer_call_path("target_url", config))
    return valid.where(urls.has_literal_segment("canonical_path")).withColumn("host", urls.absolute_host("target_url", config))


def egress_rows(calls: DataFrame, sdk: DataFrame, config: Config, most: int = EGRESS_CAP) -> DataFrame:
    """(owner_id, file, line, target, mechanism): calls to external hosts, else by external variables, and SDK calls; capped for each service."""
    host = F.when(urls.host_in(F.col("host"), config.external_domains), F.col("host"))
    env = urls.env_var_name("target_url")
    variable = F.when(urls.is_env_var_base("target_url") & urls.among(env, config.external_env), env)
    named = calls.where(F.col("line") > 0).select("owner_id", "file", "line", F.coalesce(host, variable).alias("target"), F.when(host.isNotNull(), "host").otherwise("env_var").alias("mechanism"))
    rows = named.where("target is not null").unionByName(sdk.select("owner_id", "file", "line", F.col("package").alias("target"), F.lit("sdk").alias("mechanism")))
    return capped(rows.distinct(), ["owner_id"], ["file", "line", "target", "mechanism"], most)


def candidate_signals(facts: DataFrame) -> DataFrame:
    """facts (callee, package, first_argument, awaited) with a column for each sign of a network call, and whether there is one."""
    root, last = F.substring_index("callee", ".", 1), F.substring_index("callee", ".", -1)
    text = F.coalesce("first_argument", F.lit(""))
    signals = {
        "global_fetch": F.col("callee").isin("fetch", "window.fetch", "globalThis.fetch"),
        "beacon": F.col("callee") == "navigator.sendBeacon",
        "network_package": F.coalesce(F.col("package").isin(*NETWORK_PACKAGES), F.lit(False)),
        "url_argument": text.rlike(r"^[`\"']?(https?|wss?)://"),
        "awaited_text": F.col("awaited") & text.rlike("^[`\"']"),
        "client_name": root.rlike(CLIENT_NAMES) & F.col("callee").contains("."),
        "messaging": last.isin(*SENDERS, *RECEIVERS) & text.rlike("^[`\"']"),
    }
    out = facts.withColumns(signals)
    return out.withColumn("candidate", F.array_contains(F.array(*signals), True))


def clean_results(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null-like texts as null, outer parentheses off (three deep), node: sources null, rows of a blank topic dropped."""
    out = rows
    for c in columns:
        value = F.trim(F.col(c))
        for _ in range(3):
            value = F.regexp_replace(value, r"(?s)^\(([^()]*(?:\([^()]*\)[^()]*)*)\)$", "$1")
        out = out.withColumn(c, F.when(~F.lower(value).isin(*NULL_LIKE), value))
    if "import_source" in out.columns:
        out = out.withColumn("import_source", F.when(~F.col("import_source").startswith("node:"), F.col("import_source")))
    return out.where(F.trim("topic") != "") if "topic" in out.columns else out


def propagate_aliases(aliases: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, alias, env): aliases (file, alias, env) with those that files get by imports (file, kind, exported, local, from_file); own ones win.

    A named import takes its name and names below it, a default import default, a namespace import all as local.name.
    """
    source = aliases.select(F.col("file").alias("from_file"), "alias", "env")
    joined = imports.join(source, "from_file")
    below = F.col("alias").startswith(F.concat("exported", F.lit(".")))
    name = (
        F.when(F.col("kind") == "namespace", F.concat_ws(".", "local", "alias"))
        .when((F.col("kind") == "default") & (F.col("alias") == "default"), F.col("local"))
        .when((F.col("kind") == "named") & (F.col("alias") == F.col("exported")), F.col("local"))
        .when((F.col("kind") == "named") & below, F.concat(F.col("local"), F.expr("substring(alias, length(exported) + 1)")))
    )
    got = joined.select("file", name.alias("alias"), "env").where("alias is not null").groupBy("file", "alias").agg(F.min("env").alias("env"))
    return aliases.select("file", "alias", "env").unionByName(got.join(aliases.select("file", "alias"), ["file", "alias"], "left_anti"))


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """(run, file, line, code, message) from compiler output (run, number, text); indented lines continue the message before."""
    head = r"^(.+?)\((\d+),(\d+)\): error TS(\d+): (.*)$"
    marked = lines.withColumn("starts", F.col("text").rlike(head).cast("int"))
    grouped = marked.withColumn("block", F.sum("starts").over(Window.partitionBy("run").orderBy("number"))).where((F.col("block") > 0) & (F.col("text").rlike(head) | F.col("text").rlike(r"^\s+\S")))
    texts = F.array_sort(F.collect_list(F.struct("number", "text")))
    blocks = grouped.groupBy("run", "block").agg(texts.alias("t"))
    first = F.col("t")[0]["text"]
    more = F.array_join(F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x: F.trim(x["text"])), "\n")
    part = lambda i: F.regexp_extract(first, head, i)
    return blocks.select("run", part(1).alias("file"), part(2).cast("int").alias("line"), part(4).cast("int").alias("code"), F.concat_ws("\n", part(5), F.nullif(more, F.lit(""))).alias("message"))


def poisoned_aliases(entries: DataFrame, imports: DataFrame, bad_files: DataFrame) -> DataFrame:
    """The aliases (alias, file) whose file imports a bad one, directly or through others, or is one itself."""
    backwards = imports.select(F.col("to_file").alias("src"), F.col("file").alias("dst")).distinct()
    hit = reachable(backwards, bad_files.select(F.col("file").alias("node"))).select(F.col("node").alias("file"))
    return entries.join(hit, "file", "left_semi").select("alias").distinct()


def aliases_at(spans: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(alias, code): diagnostics (file, line, code) by the span (alias, file, first, last) that holds their line: equi-join on the file, then the range."""
    return diagnostics.join(spans, "file").where("line between first and last").select("alias", "code").distinct()


def type_states(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """entries (alias, is_explicit) with type_state: explicit; unknown if the alias's text holds any or unknown; implicit if it is defined; else unknown."""
    joined = entries.join(texts.select("alias", "text"), "alias", "left")
    bad = keys.normalised_top_type("text")
    state = F.when(F.col("text").isNotNull() & bad, "unknown").when(F.col("is_explicit"), "explicit").when(F.col("text").isNotNull(), "implicit").otherwise("unknown")
    return joined.withColumn("type_state", state).drop("text")


def inherit_depth(anchors: DataFrame, inferred: DataFrame) -> DataFrame:
    """anchors (alias, symbol, depth) with the array depth inferred for the same alias and symbol where they have none."""
    known = inferred.groupBy("alias", "symbol").agg(F.max("depth").alias("inferred_depth"))
    return anchors.join(known, ["alias", "symbol"], "left").withColumn("depth", F.coalesce("depth", "inferred_depth", F.lit(0))).drop("inferred_depth")
