"""URLs of calls as Column expressions: normal form, canonical consumer path, environment variables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.functions.paths import col, is_param, let, segments

QUOTES = "^[`\"']+|[`\"']+$"
#: The last identifier of an interpolation, and any interpolation; one without an end runs to the end of the text.
NAMED = r"(?U)\$\{(?:[^}]*[^\w}])?([\p{Alpha}_]\w*)[^\w}]*(?:\}|$)"
OTHER = r"\$\{[^}]*(?:\}|$)"


@dataclass(frozen=True)
class Config:
    """Declared environment variables and domains, of all services together."""

    internal_env: tuple[str, ...] = ()
    external_env: tuple[str, ...] = ()
    internal_domains: tuple[str, ...] = ()
    external_domains: tuple[str, ...] = ()


def among(value: Column, names: tuple[str, ...]) -> Column:
    return value.isin(*names) if names else F.lit(False)


def unquoted(url: Column | str) -> Column:
    return F.regexp_replace(col(url), QUOTES, "")


def interpolations_to_params(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, NAMED, r":$1"), OTHER, ":param")


def clean_path(path: Column) -> Column:
    """Query, fragment and quotes off, a slash in front, one trailing slash off, then no double slashes."""
    cut = unquoted(F.split(F.split(path, r"\?", 2)[0], "#", 2)[0])
    lead = F.regexp_replace(cut, "(?s)^(?!/)", "/")
    return F.regexp_replace(F.regexp_replace(lead, "(?s)(?<=.)/$", ""), "/+", "/")


def domain_host(domain: str) -> str:
    """The host of a configured domain, which may carry a scheme, a path and a port."""
    low = domain.lower()
    for scheme in ("https://", "http://"):
        low = low.removeprefix(scheme)
    return low.split("/")[0].split(":")[0]


def host_in(host: Column, domains: tuple[str, ...]) -> Column:
    """Is the host, port off and in lower case, one of the domains or under one?"""
    h = F.lower(F.split(host, ":", -1)[0])
    out = F.lit(False)
    for d in map(domain_host, domains):
        out = out | (h == d) | h.endswith("." + d)
    return out


def process_env_path(url: Column) -> Column:
    after = F.regexp_replace(F.trim(F.regexp_extract(url, r"(?s)\+(.*)$", 1)), QUOTES, "")
    rest = F.regexp_extract(url, r"(?Us)process\.env\.\w*(.*)$", 1)
    slash = F.regexp_extract(rest, r"(?s)(/.*)$", 1)
    return F.when(url.contains("+"), after).when(slash != "", slash).otherwise("/")


def normalize_url(url: Column | str, config: Config) -> Column:
    """A struct of path, is_internal, is_external, stripped_host and is_unresolved. The order of the cases matters."""
    return let(unquoted(url), lambda u: _normalized(u, config))


def _normalized(u: Column, config: Config) -> Column:
    def out(path: Column, internal: Column, external: Column, host: Column, unresolved: Column | None = None) -> Column:
        return F.struct(
            path.alias("path"), internal.alias("is_internal"), external.alias("is_external"), host.cast("string").alias("stripped_host"), (F.lit(False) if unresolved is None else unresolved).alias("is_unresolved")
        )

    none = F.lit(None).cast("string")
    parts = F.split(u, ":", 3)
    name = parts[1]
    env = out(
        F.when(F.size(parts) >= 3, clean_path(interpolations_to_params(F.get(parts, F.lit(2))))).otherwise("/"),
        among(name, config.internal_env), among(name, config.external_env), F.concat(F.lit("ENV_VAR:"), name),
    )
    bare = F.regexp_replace(u, "^(https?:)?//", "")
    host = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    after_host = F.regexp_extract(bare, r"(?s)^[^/]*(/.*)$", 1)
    full = out(
        clean_path(interpolations_to_params(F.when(after_host == "", "/").otherwise(after_host))),
        host_in(host, config.internal_domains), host_in(host, config.external_domains), host,
    )
    process = F.regexp_extract(u, r"(?U)process\.env\.(\w+)", 1)
    from_process = out(
        clean_path(interpolations_to_params(process_env_path(u))),
        among(process, config.internal_env), among(process, config.external_env),
        F.when(process != "", F.concat(F.lit("process.env."), process)),
    )
    stripped = u.startswith("${") & u.contains("}")
    variable = F.regexp_extract(u, r"(?s)^\$\{([^}]*)\}", 1)
    rest = F.when(stripped, F.regexp_replace(u, r"(?s)^\$\{[^}]*\}", "")).otherwise(u)
    inside, outside = stripped & among(variable, config.internal_env), stripped & among(variable, config.external_env) & ~among(variable, config.internal_env)
    left = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), "^/+|/+$", "")
    template = out(
        clean_path(interpolations_to_params(rest)), inside, outside,
        F.when(inside | outside, F.concat(F.lit("${"), variable, F.lit("}"))), stripped & ~inside & ~outside & (left == ""),
    )
    plain = out(clean_path(u), F.lit(False), F.lit(False), none)
    return (
        F.when(u.startswith("ENV_VAR:"), env)
        .when(u.rlike("^(https?:)?//"), full)
        .when(u.contains("process.env."), from_process)
        .when(u.contains("${"), template)
        .otherwise(plain)
    )


def absolute_host(url: Column | str, config: Config = Config()) -> Column:
    """The host of a literal origin."""
    u = unquoted(url)
    host = normalize_url(url, config)["stripped_host"]
    return F.when(u.rlike("^(https?:)?//") & (host != "") & ~host.contains("$") & ~host.contains("{"), host)


def has_injected_base(u: Column) -> Column:
    base = F.trim(F.regexp_extract(u, r"(?s)^\$\{([^}]*)\}/", 1))
    shape = u.rlike(r"(?s)^\$\{[^}]*\}/")
    return shape & ~u.contains("process.env.") & ~u.contains("import.meta.env.") & ~base.rlike("^[A-Z_0-9]+$")


def is_call_path(u: Column, normal: Column) -> Column:
    """Does the normal path stand for the unquoted URL in calls?"""
    relative = u.startswith("/") & ~u.startswith("//")
    return normal["is_internal"] | relative | u.rlike("^(https?:)?//") | (~normal["is_external"] & has_injected_base(u))


def consumer_call_path(url: Column | str, config: Config) -> Column:
    """The normal path of internal, relative, absolute and injected-base URLs; any other URL as it is."""

    def of(u: Column, normal: Column) -> Column:
        return F.when(is_call_path(u, normal), normal["path"]).otherwise(col(url))

    return let(unquoted(url), lambda u: let(_normalized(u, config), lambda normal: of(u, normal)))


def consumer_route(url: Column | str, config: Config, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body of consumer_call_path(), its normal form and the URL's own normal form, which are one where the URL stays as it is."""

    def of(u: Column, own: Column) -> Column:
        known = is_call_path(u, own)
        both = F.struct(F.when(known, own["path"]).otherwise(col(url)).alias("route"), F.when(known, normalize_url(own["path"], config)).otherwise(own).alias("normal"))
        return let(both, lambda x: body(x["route"], x["normal"], own))

    return let(unquoted(url), lambda u: let(_normalized(u, config), lambda own: of(u, own)))


def has_literal_segment(path: Column | str) -> Column:
    p = F.regexp_extract(col(path), r"(?s)^([^?#]*)", 1)
    literal = lambda s: (s != "") & (s != "*") & ~is_param(s) & (F.regexp_replace(s, r"^(\$\{[^}]*\})+", "") != "")
    return p.rlike("^https?://") | F.exists(segments(p), literal)


def is_probable_url(url: Column | str) -> Column:
    u = F.trim(col(url))
    return (u != "") & (u.startswith("ENV_VAR:") | u.contains("process.env.") | u.contains("${") | u.contains("/"))


def is_valid_route_shape(route: Column | str) -> Column:
    """Routes that matching can take: ENV_VAR form, ${...} base, absolute URL or path, without traces of an expression."""
    r = F.trim(col(route))
    clean = ~r.contains("||") & ~r.rlike(r"[()\s]")
    path = F.regexp_extract(r, r"(?s)^ENV_VAR:[^:]*:(.*)$", 1)
    name = F.regexp_extract(r, r"(?s)^ENV_VAR:([^:]*):", 1)
    env = r.rlike(r"(?s)^ENV_VAR:[A-Za-z0-9_]+:/") & ~path.contains("||") & ~path.rlike(r"[()\s]") & (F.regexp_replace(path, "^/+", "") != name)
    return F.when(r.startswith("ENV_VAR:"), env).when(r.startswith("${"), r.contains("}") & clean).otherwise(r.rlike("^(https?://|/)") & clean)


def is_env_var_base(route: Column | str) -> Column:
    """Does the route begin with a base that only an environment variable tells?"""
    r = col(route)
    name = F.regexp_extract(r, r"(?s)^\$\{([^}]*)\}", 1)
    leading = r.rlike(r"(?s)^\$\{[^}]*\}")
    constant = r.rlike(r"(?U)^\p{Lu}") & F.regexp_extract(r, r"(?U)^(\w+)", 1).rlike(r"^[\p{Lu}_0-9]{2,}$")
    return r.startswith("ENV_VAR:") | r.contains("process.env.") | (leading & (name.contains(".") | name.rlike(r"^[\p{Lu}_0-9]*$") | r.rlike(r"(?s)^\$\{[^}]*\}/"))) | constant


def env_var_name(route: Column | str) -> Column:
    r = col(route)
    inner = F.regexp_extract(r, r"(?s)\$\{([^}]*)\}", 1)
    found = F.coalesce(
        F.when(r.startswith("ENV_VAR:"), F.split(r, ":", 3)[1]),
        F.when(r.rlike(r"(?s)\$\{[^}]*\}"), F.regexp_extract(inner, r"(?s)([^.]*)$", 1)),
        F.nullif(F.regexp_extract(r, r"(?U)process\.env\.(\w+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(r, r"(?U)^(\p{Lu}\w*)", 1), F.lit("")),
    )
    return F.coalesce(found, F.lit("UNKNOWN_API"))


def is_declared_call(route: Column | str, env: tuple[str, ...], domains: tuple[str, ...]) -> Column:
    """A route of a declared variable, or one that begins with a declared domain (as text, unlike host_in)."""
    r = col(route)
    begins = F.lit(False)
    for d in domains:
        begins = begins | r.startswith(d)
    return F.when(r.startswith("ENV_VAR:"), among(F.split(r, ":", -1)[1], env)).otherwise(begins)
