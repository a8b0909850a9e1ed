"""GraphQL texts: schemas give producers, documents give consumers. A small tokenizer, no parser library."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\])*\"|#[^\n]*|\.\.\.|[A-Za-z_][A-Za-z0-9_]*|[{}()\[\]:!@$=|&]|\S", re.S)
ROOTS = {"Query": "query", "Mutation": "mutation", "Subscription": "subscription"}


def lexed(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if t[0] not in "#\""]


def closing(tokens: list[str], at: int) -> int:
    """Where the bracket that opens at this place closes, or the end."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] in ("{", "(", "[")) - (tokens[i] in ("}", ")", "]"))
        if depth == 0:
            return i
    return len(tokens)


def producers(text: str) -> list[tuple[str, str, str]]:
    """(kind, field, type) of the root types' fields in a schema; schema { query: X } renames the roots."""
    t, roots, out = lexed(text), dict(ROOTS), []
    for i, x in enumerate(t):
        if x == "schema" and t[i + 1 : i + 2] == ["{"]:
            for j in range(i + 2, closing(t, i + 1) - 2):
                if t[j] in ROOTS.values() and t[j + 1] == ":":
                    roots = {k: v for k, v in roots.items() if v != t[j]} | {t[j + 2]: t[j]}
    i = 0
    while i < len(t):
        if t[i] == "type" and i + 1 < len(t) and t[i + 1] in roots and "{" in t[i:]:
            kind, j = roots[t[i + 1]], t.index("{", i) + 1
            end = closing(t, j - 1)
            while j < end:
                name, k = t[j], j + 1
                if k < end and t[k] == "(":
                    k = closing(t, k) + 1
                if k < end and t[k] == ":" and name[0].isalpha() | (name[0] == "_"):
                    k += 1
                    first = k
                    while k < end and (t[k] in "[]!" or k == first or t[k - 1] == "["):
                        k += 1
                    out.append((kind, name, "".join(t[first:k])))
                    j = k
                else:
                    j += 1
            i = end
        i += 1
    return out


def consumers(text: str) -> list[tuple[str, str]]:
    """(kind, field) of the top-level fields of a document's operations: alias ignored, spreads and __ fields skipped."""
    t, out, i = lexed(text), [], 0
    while i < len(t):
        kind = t[i] if t[i] in ROOTS.values() else "query" if t[i] == "{" else None
        if t[i] == "fragment" or kind is None:
            i = closing(t, t.index("{", i)) + 1 if t[i] == "fragment" and "{" in t[i:] else i + 1
            continue
        while i < len(t) and t[i] != "{":
            i = closing(t, i) + 1 if t[i] == "(" else i + 1
        end, j = closing(t, i) if i < len(t) else len(t), i + 1
        while j < end:
            if t[j] == "...":
                j += 1
                while j < end and t[j] != "{" and t[j - 1] in ("...", "on", "@"):
                    j += 1
                j = closing(t, j) + 1 if j < end and t[j] == "{" else j
            elif re.match("[A-Za-z_]", t[j]):
                name, j = (t[j + 2], j + 3) if j + 2 < end and t[j + 1] == ":" else (t[j], j + 1)
                while j < end and (t[j] in ("(", "{", "@")):
                    j = j + 2 if t[j] == "@" else closing(t, j) + 1
                if not name.startswith("__"):
                    out.append((kind, name))
            else:
                j += 1
        i = end + 1
    return out


def operations(files: DataFrame) -> DataFrame:
    """(path, side, kind, field, type) of GraphQL files (path, content): schemas are endpoints, documents calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows += [(path, "endpoint", *p) for p in producers(content or "")] or [(path, "call", *c, None) for c in consumers(content or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["path", "side", "kind", "field", "type"])

    return files.select("path", "content").mapInArrow(run, "path string, side string, kind string, field string, type string")
