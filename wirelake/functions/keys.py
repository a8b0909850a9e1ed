"""Operation keys, locations, aliases and other names as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wirelake.functions.paths import col, compat_path

# HTTP methods, and the directories and endings of tests and mocks.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def canonical_method(method: Column | str) -> Column:
    m = F.upper(F.trim(F.coalesce(col(method), F.lit(""))))
    return F.when(m == "", "UNKNOWN").otherwise(m)


def is_http_method(method: Column | str) -> Column:
    return canonical_method(method).isin(*METHODS)


def consumer_method(method: Column | str) -> Column:
    """GET where the method is unknown; null where it is none of HTTP's."""
    m = canonical_method(method)
    return F.when(m == "UNKNOWN", "GET").when(m.isin(*METHODS), m)


def canonical_key(protocol: Column, method: Column, path: Column, gql_kind: Column, field: Column, event: Column, direction: Column, topic: Column) -> Column:
    """http|M|p, graphql|kind|f, socket|DIR|e or pubsub|t."""
    return (
        F.when(protocol == "http", F.concat_ws("|", F.lit("http"), method, path))
        .when(protocol == "graphql", F.concat_ws("|", F.lit("graphql"), gql_kind, field))
        .when(protocol == "socket", F.concat_ws("|", F.lit("socket"), direction, event))
        .when(protocol == "pubsub", F.concat_ws("|", F.lit("pubsub"), topic))
    )


def verdict_key(key: Column | str) -> Column:
    """(method, identity) of a canonical key, by which verdicts are joined; null for other protocols and blank parts."""
    parts = F.split(col(key), r"\|", 3)
    kind, a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    named = (a != "") & (b != "")
    of = lambda method, identity: F.struct(method.alias("method"), identity.alias("identity"))
    return (
        F.when((kind == "http") & named, of(F.upper(a), b))
        .when((kind == "socket") & named, of(F.lit("SOCKET"), F.concat_ws("|", a, b)))
        .when((kind == "graphql") & named, of(F.lit("GRAPHQL"), F.concat_ws("|", a, b)))
        .when((kind == "pubsub") & (a != "") & b.isNull(), of(F.lit("PUBSUB"), a))
    )


def display_labels(key: Column | str) -> Column:
    """(label, name) of a canonical key as reports show them; null for other protocols and blank parts."""
    parts = F.split(col(key), r"\|", 3)
    kind, a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    named = (a != "") & (b != "")
    of = lambda label, name: F.struct(label.alias("label"), name.alias("name"))
    return (
        F.when(kind.isin("http", "socket") & named, of(a, b))
        .when((kind == "graphql") & named, of(F.upper(a), b))
        .when((kind == "pubsub") & (a != "") & b.isNull(), of(F.lit("PUBSUB"), a))
    )


def file_of(location: Column | str) -> Column:
    loc = col(location)
    return F.when(loc.rlike(r"(?s)^.*?:\d+(:\d+)?$"), F.regexp_extract(loc, r"(?s)^(.*?):\d+(?::\d+)?$", 1)).otherwise(loc)


def line_of(location: Column | str) -> Column:
    line = F.regexp_extract(col(location), r"(?s)^.*?:(\d+)(?::\d+)?$", 1).try_cast("int")
    return F.greatest(F.coalesce(line, F.lit(1)), F.lit(1))


def without_workspace(location: Column | str) -> Column:
    return F.regexp_replace(col(location), "^/home/runner/work/[^/]*/[^/]*/(?=.)", "")


def truncated(text: Column | str, most: int) -> Column:
    t = col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def same_source_file(a: Column, b: Column) -> Column:
    """Equal, or one ends the other on a directory boundary."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def type_name(route: Column | str) -> Column:
    """A route as a type's name: /users/:id as UsersById."""
    path = F.regexp_replace(col(route), r"(?s)\?.*$", "")
    words = F.transform(
        F.filter(F.split(path, "/", -1), lambda s: s != ""),
        lambda s: F.concat(F.when(s.startswith(":"), "By").otherwise(""), F.regexp_replace(F.initcap(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " ", "")),
    )
    return F.array_join(words, "")


def fnv32(text: Column | str) -> Column:
    """FNV-1a, 32 bits, over UTF-8 bytes, as eight hexadecimal digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(col(text), "UTF-8")), F.lit("(..)"))
    total = F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16777619).cast("long") % F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(total), 8, "0"))


def fnv64(text: Column | str) -> Column:
    """FNV-1a, 64 bits, as sixteen hexadecimal digits. Spark has no wrapping product, hence Python over Arrow."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    @F.arrow_udf(StringType())
    def digest(values: pa.Array) -> pa.Array:
        return pa.array([one(s) for s in values.to_pylist()], pa.string())

    return digest(col(text))


def type_alias(key: Column | str, role: Column, kind: Column, call_id: Column | None = None) -> Column:
    """Endpoint_<hash>_<Kind>, with _Call<id> for a call site. role is producer or consumer, kind Request or Response."""
    base = F.concat(F.lit("Endpoint_"), fnv64(F.concat_ws("|", col(key), role, kind)), F.lit("_"), kind)
    if call_id is None:
        return base
    return F.when(F.trim(F.coalesce(call_id, F.lit(""))) != "", F.concat(base, F.lit("_Call"), F.trim(call_id))).otherwise(base)


def repo_relative(path: Column | str, root: Column | str) -> Column:
    """The path below the root, if it is there, without a leading ./"""
    p, r = col(path), F.regexp_replace(col(root), "/+$", "")
    below = (~r.isin("", ".")) & p.startswith(F.concat(r, F.lit("/")))
    return F.regexp_replace(F.when(below, F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p), r"^\./", "")


def call_site_id(path: Column | str, line: Column | str, key: Column | str, root: Column | str) -> Column:
    """The id of a call site by its place below the repository's root, and its key."""
    return fnv64(F.concat_ws("|", repo_relative(path, root), col(line).cast("string"), col(key)))


def repo_name(slug: Column | str, path: Column | str) -> Column:
    """The last part of the owner/repository slug, else of the path."""
    last = F.element_at(F.filter(F.split(col(path), "/"), lambda s: s != ""), -1)
    return F.coalesce(F.element_at(F.split(col(slug), "/"), -1), F.when(F.regexp_replace(col(path), "/", "") != "", last), F.lit("."))


def scoring_key(key: Column | str) -> Column:
    """A canonical key as scorers compare it: verb in upper case, parameters as :param, no trailing slash."""
    parts = F.split(col(key), r"\|", 3)
    path = compat_path(F.get(parts, F.lit(2)))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(F.size(parts) == 3, F.concat_ws("|", F.get(parts, F.lit(0)), F.upper(F.get(parts, F.lit(1))), path)).otherwise(col(key))


def one_blank(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def normalised_top_type(text: Column | str) -> Column:
    """Does a type text hold any or unknown as a type, outside strings and property names?"""
    bare = F.regexp_replace(col(text), "\"[^\"]*\"|'[^']*'|`[^`]*`", "")
    return bare.rlike(r"(?<![\w$])(any|unknown)(?![\w$])(?!\??:)")


def topic_pattern(template: Column | str) -> Column:
    """A topic template, ${...} for any text, as a LIKE pattern."""
    escaped = F.regexp_replace(col(template), r"([%_\\])", r"\\$1")
    return F.regexp_replace(escaped, r"\$\{[^}]*\}", "%")
