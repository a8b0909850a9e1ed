"""Version specifications as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake.functions.paths import col

# A strict version's form, and the largest number in it.
IDENTIFIER = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER = rf"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-({IDENTIFIER}(?:\.{IDENTIFIER})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
LARGEST = 2**64 - 1


def clean_spec(spec: Column | str) -> Column:
    """Range marks off in their order; the upper end of a range; the first of alternatives."""
    out = col(spec)
    for mark in (r"\^", "~", ">=", "<=", ">", "<", "="):
        out = F.regexp_replace(out, f"^({mark})+", "")
    ends = F.split(out, " - ", -1)
    return F.trim(F.when(F.size(ends) == 2, F.get(ends, F.lit(1))).when(F.size(ends) > 2, out).otherwise(F.split(out, r" \|\| ", -1)[0]))


def semver(version: Column | str) -> Column:
    """(major, minor, patch, release, pre): ordered as versions are, a release after its pre-releases; null if not strict.

    pre has the identifiers one by one: numbers before words, numbers by size (length, then digits), and a list before its continuations.
    """
    v = col(version)
    part = lambda i: F.regexp_extract(v, SEMVER, i)
    numbers = [part(i + 1).try_cast("decimal(38,0)") for i in range(3)]
    number = lambda x: x.rlike(r"^\d+$")
    pre = F.transform(
        F.filter(F.split(part(4), r"\."), lambda x: x != ""),
        lambda x: F.struct((~number(x)).cast("int").alias("word"), F.when(number(x), F.length(x)).otherwise(0).alias("digits"), x.alias("text")),
    )
    fits = F.lit(True)
    for n in numbers:
        fits = fits & F.coalesce(n <= F.lit(str(LARGEST)).cast("decimal(38,0)"), F.lit(False))
    return F.when(v.rlike(SEMVER) & fits, F.struct(*(n.alias(name) for n, name in zip(numbers, ("major", "minor", "patch"), strict=True)), (part(4) == "").alias("release"), pre.alias("pre")))
