"""Function bodies, call targets and type texts as expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wirelake.functions.paths import col

TRIVIAL_CHARS = 80
#: Pieces of an interpolated text: strings with their escapes, brackets, fallback operators (runs count as one), anything else.
LEXEME = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|\|\|+|\?\?+|.", re.S)


def is_trivial(body: Column | str) -> Column:
    b = F.trim(col(body))
    return ~b.contains("\n") & (F.length(b) <= TRIVIAL_CHARS)


def mentions(body: Column | str, name: Column | str) -> Column:
    """Does the body hold the name as a whole identifier?"""
    n = col(name)
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), n, F.lit(r"\E(?![A-Za-z0-9_$])"))
    return (n != "") & F.regexp_like(col(body), quoted)


def is_local_callee(caller: Column, body: Column, candidate: Column) -> Column:
    """A function that the body names, of no class, of the caller's class, or of a class that the body names too."""
    head = lambda k: F.when(k.contains("."), F.substring_index(k, ".", 1))
    own = head(candidate)
    return (candidate != caller) & mentions(body, F.substring_index(candidate, ".", -1)) & (own.isNull() | F.coalesce(head(caller) == own, F.lit(False)) | mentions(body, F.coalesce(own, F.lit(""))))


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 over length-prefixed parts; null parts differ from empty ones."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(col(p)), F.lit(":"), col(p)), F.lit("-")) for p in parts)), 256)


def call_site_path(url: Column | str) -> Column:
    """The path of a call's URL: a leading ${...}/ or origin off, query and fragment cut, ${a.b} as :b; empty names vanish."""
    u = col(url)
    path = F.when(u.startswith("${") & u.contains("}/"), F.regexp_replace(u, r"(?s)^.*?\}(?=/)", "")).when(u.rlike("^https?://[^/]*/"), F.regexp_replace(u, "^https?://[^/]*", "")).otherwise(u)
    cut = F.regexp_replace(path, r"(?s)[?#].*$", "")
    named = F.regexp_replace(cut, r"\$\{(?:[^}]*\.)?([^.}]+)(?:\}|$)", ":$1")
    return F.regexp_replace(named, r"\$\{[^}]*(?:\}|$)", "")


def with_env_alias(target: Column | str, aliases: Column | str) -> Column:
    """A leading ${alias} as ${process.env.NAME} by a map of aliases; other targets as they are."""
    t = col(target)
    name = F.try_element_at(col(aliases), F.regexp_extract(t, "(?s)^[`\"']*\\$\\{([^}]*)\\}", 1))
    lead = F.regexp_extract(t, "^([`\"']*)", 1)
    rest = F.regexp_replace(t, "(?s)^[`\"']*\\$\\{[^}]*\\}", "")
    return F.when(name.isNotNull(), F.concat(lead, F.lit("${process.env."), name, F.lit("}"), rest)).otherwise(t)


def list_depth(type_text: Column | str) -> Column:
    """How many lists a GraphQL type begins with."""
    return F.length(F.regexp_extract(col(type_text), r"^(\[*)", 1))


def without_fallback(text: str | None) -> str | None:
    """${REF ?? other} and ${REF || other} as ${REF}, for a plain reference; strings and brackets are kept together."""
    if text is None:
        return None
    out, at = [], 0
    while (start := text.find("${", at)) >= 0:
        out.append(text[at:start])
        depth, pos, operator, end = 0, start + 2, None, None
        for m in LEXEME.finditer(text, start + 2):
            piece, pos = m[0], m.end()
            if piece == "}" and depth == 0:
                end = m.start()
                break
            if piece in "{([":
                depth += 1
            elif piece in "})]":
                depth = max(0, depth - 1)
            elif depth == 0 and operator is None and piece[:2] in ("??", "||"):
                operator = m.start()
        if end is None:
            return "".join([*out, text[start:]])
        reference, other = (text[start + 2 : operator].strip(), text[operator + 2 : end].strip()) if operator else ("", "")
        plain = reference and other and re.fullmatch(r"[A-Za-z0-9_$.]+", reference)
        out.append("${" + reference + "}" if plain else text[start:pos])
        at = pos
    return "".join([*out, text[at:]])


def env_fallback_target(target: Column | str) -> Column:
    """without_fallback as an expression; the scan is not regular, hence Arrow, and only for texts that hold an operator."""

    @F.arrow_udf(StringType())
    def scan(values: pa.Array) -> pa.Array:
        return pa.array([without_fallback(v) for v in values.to_pylist()], pa.string())

    t = col(target)
    return F.when(t.contains("${") & (t.contains("??") | t.contains("||")), scan(t)).otherwise(t)
