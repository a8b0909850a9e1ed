"""The report in Markdown, from findings that are few enough to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.operators import findings as fn

TITLES = {
    "type_mismatch": "Incompatible types", "method_mismatch": "Wrong methods", "missing_endpoint": "Missing endpoints", "orphaned_endpoint": "Endpoints that nothing calls",
    "env_var_call": "Undeclared environment variables", "shared_external_contract": "Shared external contracts", "dependency_conflict": "Dependency conflicts",
}
#: Rows shown of each section; the section's title has the whole number.
MOST_ROWS = 200


def cell(value: object) -> str:
    if isinstance(value, (list, tuple)):
        value = ", ".join(str(tuple(v) if isinstance(v, tuple) else v) for v in value)
    return "" if value is None else str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def section(title: str, rows: list, total: int) -> list[str]:
    shown = [c for c in rows[0].asDict() if any(r[c] is not None for r in rows)]
    out = [f"## {title} ({total})", "", "| " + " | ".join(shown) + " |", "|" + " - |" * len(shown)]
    out += ["| " + " | ".join(cell(r[c]) for c in shown) + " |" for r in rows]
    if total > len(rows):
        out.append(f"\n{total - len(rows)} more are in the findings table.")
    return [*out, ""]


def delta_section(delta: DataFrame | None) -> list[str]:
    """New and removed endpoints (change, method, path, service, still_consumed, packages, consumers); without a prior index there is no section."""
    if delta is None:
        return []
    rows = delta.orderBy("change", "path", "method").limit(MOST_ROWS).collect()
    if not rows:
        return []
    out = ["## In this change", ""]
    for r in rows:
        line = f"- {'New endpoint' if r['change'] == 'new' else 'Removed'} `{cell(r['method'])} {cell(r['path'])}`" + (f" (`{cell(r['service'])}`)" if r["service"] else "")
        if r["change"] != "new" and r["still_consumed"]:
            line += ", still called"
        elif r["change"] != "new" and r["packages"]:
            line += f", still reached through {cell(r['packages'])} by {cell(r['consumers'])}"
        out.append(line)
    return [*out, ""]


def verified_section(verified: DataFrame | None) -> list[str]:
    """How many verified routes are compatible, unverifiable and not compared (method, path, verdict)."""
    if verified is None:
        return []
    counts = {r["bucket"]: r["count"] for r in verified.groupBy(F.coalesce("verdict", F.lit("not compared")).alias("bucket")).count().collect()}
    return ["## Verified endpoints", "", *(f"- {name}: {counts[name]}" for name in ("compatible", "unverifiable", "not compared") if name in counts), ""] if counts else []


def sdk_section(edges: DataFrame | None) -> list[str]:
    """Consumers by published client package (package, consumer)."""
    rows = edges.groupBy("package").agg(F.array_sort(F.collect_set("consumer")).alias("consumers")).orderBy("package").limit(MOST_ROWS).collect() if edges is not None else []
    return ["## Through client packages", "", *(f"- `{cell(r['package'])}`: {cell(r['consumers'])}" for r in rows), ""] if rows else []


def verdict_line(counts: dict, issues: int, has_baseline: bool) -> str:
    """One line that says how grave it is: risks first, then gaps, then advice only."""
    if counts["risks"]:
        return f"> **{issues} issue(s)**, {counts['risks']} of them break callers."
    if issues:
        return f"> **{issues} issue(s)**."
    rest = "" if has_baseline else " Without other services, endpoints without a counterpart don't count."
    return f"> No issues, only advice.{rest}"


def render(findings: DataFrame, has_baseline: bool = True, delta: DataFrame | None = None, verified: DataFrame | None = None, sdk: DataFrame | None = None, graphql: bool = False) -> str:
    """Sections in their fixed order; the marker on top carries the number of issues."""
    counts = fn.issues(fn.categories(findings), has_baseline).first().asDict()
    out = [f"<!-- issues: {counts['issues']} -->", "# Service contracts", ""]
    tail = [*delta_section(delta), *verified_section(verified), *sdk_section(sdk), *(["GraphQL operations are matched by kind and field.", ""] if graphql else [])]
    numbers = {r["kind"]: r["count"] for r in findings.groupBy("kind").count().collect()}
    if not numbers:
        return "\n".join([*out, "No issues found.", "", *tail])
    out += [verdict_line(counts, counts["issues"], has_baseline), "", *tail]
    for kind, title in TITLES.items():
        if kind in numbers:
            rows = findings.where(F.col("kind") == kind).drop("kind", "section")
            order = [c for c in ("path", "method", "env_var", "package_name", "package") if c in rows.columns]
            out += section(title, rows.orderBy(*order).limit(MOST_ROWS).collect(), numbers[kind])
    return "\n".join(out)
