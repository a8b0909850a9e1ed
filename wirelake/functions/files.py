"""Routes that file paths imply: conventions as data, compiled to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.functions.paths import col, let


@dataclass(frozen=True)
class Convention:
    """Where routes lie, and how a file's place spells its path. terminals: the folder names the route; else the file does."""

    name: str
    roots: tuple[str, ...]
    terminals: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    separator: str = ""
    prefix: str = ""
    dynamic: tuple[str, str] = ("[", "]")
    rest_mark: str = "..."
    group: tuple[str, str] = ("(", ")")
    exports: tuple[tuple[str, str], ...] = ()


# The built-in conventions.
APP_DIR = Convention("nextjs-app", ("app", "src/app"), terminals=("route.ts", "route.js", "route.tsx", "route.mts"))
PAGES_DIR = Convention("nextjs-pages", ("pages/api", "src/pages/api"), extensions=("ts", "js", "tsx", "jsx"), prefix="/api")
ASTRO = Convention("astro", ("src/pages",), extensions=("ts", "js"), group=("", ""))
FLAT = Convention("remix-flat", ("app/routes", "src/app/routes"), extensions=("ts", "js"), separator=".", dynamic=("$", ""), rest_mark="", group=("_", ""), exports=(("loader", "GET"), ("action", "POST")))
BUILT_IN = (APP_DIR, PAGES_DIR, ASTRO, FLAT)


def _segment(raw: Column, c: Convention) -> Column:
    """The path's segment for a file segment; null for a group."""
    before, after = c.dynamic
    inner = F.substring(raw, F.lit(len(before) + 1), F.length(raw) - len(before) - len(after))
    name = F.replace(F.trim(inner), F.lit("."), F.lit(""))
    value = F.when(name == "", "**").otherwise(F.concat(F.lit(":"), name))
    if c.rest_mark:
        value = F.when(inner.startswith(c.rest_mark), "**").otherwise(value)
    out = F.when(raw.startswith(before) & raw.endswith(after) & (F.length(raw) >= len(before) + len(after)), value).otherwise(raw)
    if after:
        out = F.when(raw.startswith(before * 2) & raw.endswith(after * 2), "**").otherwise(out)
    if c.group[0]:
        out = F.when(~(raw.startswith(c.group[0]) & raw.endswith(c.group[1])), out)
    return out


def _path(parts: Column, c: Convention) -> Column:
    file, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    if c.terminals:
        fits, segments = file.isin(*c.terminals), folders
    else:
        stem = F.regexp_replace(file, r"\.[^.]*$", "")
        fits = ~file.startswith("_") & F.regexp_extract(file, r".\.([^.]*)$", 1).isin(*c.extensions)
        names = F.filter(F.split(stem, "[" + c.separator + "]"), lambda s: s != "") if c.separator else F.array(stem)
        kept = F.when(F.element_at(names, -1) == "index", F.slice(names, F.lit(1), F.size(names) - 1)).otherwise(names)
        segments = F.concat(folders, F.when(F.size(names) > 0, kept).otherwise(names))
    spelled = F.filter(F.transform(segments, lambda s: _segment(s, c)), lambda s: s.isNotNull())
    full = F.concat(F.lit(c.prefix), F.array_join(F.transform(spelled, lambda s: F.concat(F.lit("/"), s)), ""))
    return F.when(fits, F.when(full == "", "/").otherwise(full))


def route_of(path: Column | str, conventions: tuple[Convention, ...] = BUILT_IN) -> Column:
    """(convention, path) of the first convention that takes the file; null if none does."""
    rel = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")
    return F.coalesce(*(_tried(rel, c) for c in conventions))


def _tried(rel: Column, c: Convention) -> Column:
    root = "^(" + "|".join(sorted(c.roots, key=len, reverse=True)) + ")/"
    below = F.filter(F.split(F.regexp_replace(rel, root, ""), "/"), lambda s: s != "")
    found = let(below, lambda parts: F.when(F.size(parts) > 0, _path(parts, c)))
    return let(found, lambda p: F.when(rel.rlike(root) & p.isNotNull(), F.struct(F.lit(c.name).alias("convention"), p.alias("path"))))


def method_of_export(export: Column | str, convention: Convention) -> Column:
    """The HTTP method that an exported name serves."""
    e = col(export)
    out = F.when(F.upper(e).isin("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"), F.upper(e))
    for name, method in convention.exports:
        out = out.when(e == name, method)
    return out


def canonical_route(path: Column | str) -> Column:
    """Segments trimmed, [x] as :x without dots, [...x] as **; slashes alone are the root."""
    trimmed = F.transform(F.split(col(path), "/", -1), lambda s: F.trim(s))
    spelled = F.transform(
        trimmed,
        lambda s: F.when(s.rlike(r"^\[\.\.\..*\]$"), "**").when(s.rlike(r"^\[.*\]$"), F.concat(F.lit(":"), F.replace(F.regexp_extract(s, r"^\[(.*)\]$", 1), F.lit("."), F.lit("")))).otherwise(s),
    )
    joined = F.array_join(spelled, "/")
    return F.when(joined.rlike("^/*$"), "/").otherwise(joined)
