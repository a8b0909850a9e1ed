"""Route paths as Column expressions: segments, specificity, agreement of an endpoint with a call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of parameter and wildcard segments, and the endings of catch-all paths.
PARAM = r"(?s)^(:.*|\{.*\}|<.*>|\[.*\])$"
WILDCARDS = ("*", "**", "(.*)")
CATCH_ALL = ("/*", "/**", "/(.*)")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: without it, expressions that use a value often grow with each level."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(path: Column | str) -> Column:
    return F.split(col(path), "/", -1)


def is_param(seg: Column) -> Column:
    return seg.rlike(PARAM)


def is_blank(seg: Column) -> Column:
    return seg.rlike(r"^\s*$")


def is_literal(seg: Column) -> Column:
    return ~is_blank(seg) & ~is_param(seg) & ~seg.isin(*WILDCARDS)


def without_marks(seg: Column) -> Column:
    """A segment without its optional marks."""
    return F.regexp_replace(seg, r"\?+$", "")


def literal_specificity(path: Column | str) -> Column:
    return F.size(F.filter(segments(path), lambda s: is_literal(without_marks(s))))


def is_catch_all(path: Column | str) -> Column:
    out = F.lit(False)
    for end in CATCH_ALL:
        out = out | col(path).endswith(end)
    return out


def catch_all_prefix(path: Column | str) -> Column:
    """What stands before the catch-all: endings are taken off as long as there are any."""
    p = col(path)
    stars = F.regexp_replace(F.regexp_replace(p, r"(/\*\*)+$", ""), r"(/\*)+$", "")
    return F.when(p.endswith("/(.*)"), F.regexp_replace(p, r"(/\(\.\*\))+$", "")).otherwise(stars)


def _summed(codes: Column) -> Column:
    """The sum of the codes, or null if one is negative."""
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when((a >= 0) & (c >= 0), a + c).otherwise(-1), lambda a: F.when(a >= 0, a))


def params_agreement(endpoint: Column, call: Column) -> Column:
    """Equal literals of paths that match by parameters on either side, optional segments included; null if they don't."""
    e, c = segments(endpoint), segments(call)
    required = F.size(F.filter(e, lambda s: ~s.endswith("?")))

    def code(raw: Column, seg: Column) -> Column:
        own = without_marks(raw)
        return (
            F.when(seg.isNull(), F.when(raw.endswith("?"), 0).otherwise(-1))
            .when(is_param(own) | is_param(seg), F.when(is_blank(own) | is_blank(seg), -1).otherwise(0))
            .when(own != seg, -1)
            .otherwise(is_literal(own).cast("int"))
        )

    return F.when((F.size(c) >= required) & (F.size(c) <= F.size(e)), _summed(F.zip_with(e, c, code)))


def wildcard_agreement(endpoint: Column, call: Column) -> Column:
    """A catch-all's prefix on a segment boundary, else segment by segment with * for any one."""
    prefix = catch_all_prefix(endpoint)
    inside = (call == prefix) | call.startswith(F.concat(prefix, F.lit("/")))
    e, c = segments(endpoint), segments(call)
    codes = F.zip_with(e, c, lambda s, t: F.when(s == "*", 0).when(s != t, -1).otherwise(is_literal(s).cast("int")))
    return F.when(is_catch_all(endpoint), F.when(inside, literal_specificity(prefix))).when(F.size(e) == F.size(c), _summed(codes))


def match_agreement(endpoint: Column | str, call: Column | str) -> Column:
    """How many literal segments an endpoint's path and a call's path share; null if they don't match."""
    e, c = col(endpoint), col(call)
    return F.coalesce(F.when(e == c, literal_specificity(e)), params_agreement(e, c), wildcard_agreement(e, c))


def paths_match(endpoint: Column | str, call: Column | str) -> Column:
    return match_agreement(endpoint, call).isNotNull()


def shape_key(path: Column | str) -> Column:
    """Equal for paths that differ in parameter names only."""
    return F.array_join(F.transform(segments(path), lambda s: F.when(is_param(without_marks(s)), ":param").otherwise(without_marks(s))), "/")


def compat_path(path: Column | str) -> Column:
    """Parameters as :param; angle brackets stay."""
    return F.array_join(F.transform(segments(path), lambda s: F.when(s.rlike(r"(?s)^(:.*|\{.*\}|\[.*\])$"), ":param").otherwise(s)), "/")


def join_paths(prefix: Column | str, path: Column | str) -> Column:
    """The prefix before the path, unless the path has it already on a segment boundary."""
    p = F.regexp_replace(F.regexp_replace(col(prefix), r"/+$", ""), r"^/*", "/")
    p = F.when(p == "/", "").otherwise(p)
    q = F.regexp_replace(col(path), r"^/*", "/")
    has = (q == p) | q.startswith(F.concat(p, F.lit("/")))
    return F.when(has, q).when(q == "/", F.when(p == "", "/").otherwise(p)).otherwise(F.concat(p, q))


def join_prefix(prefix: Column | str, path: Column | str) -> Column:
    """The prefix before the path, whatever the path begins with."""
    p, q = F.regexp_replace(col(prefix), "/+$", ""), F.regexp_replace(col(path), "^/+", "")
    return F.when(p == "", F.concat(F.lit("/"), q)).when(q == "", p).otherwise(F.concat_ws("/", p, q))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Do two paths name one route: as many segments, each equal or a parameter on either side?"""
    x, y = segments(a), segments(b)
    param = lambda s: is_param(F.regexp_replace(s, r"\?$", ""))
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda s, t: (s == t) | param(s) | param(t)), lambda ok: F.coalesce(ok, F.lit(False)))


def normalize_path(path: Column | str) -> Column:
    """Empty segments dropped, one slash in front."""
    return F.concat(F.lit("/"), F.array_join(F.filter(segments(path), lambda s: s != ""), "/"))


def type_match_path(path: Column | str) -> Column:
    """The type checker's form of a path: lower case, no trailing or double slashes, parameters as :param."""
    low = F.regexp_replace(F.lower(col(path)), r"/+$", "")
    lead = F.regexp_replace(F.concat(F.lit("/"), low), "/+", "/")
    return F.array_join(F.transform(segments(lead), lambda s: F.when(s.rlike(r"(?s)^(:.*|\{.*\}|\[.*\])$") | s.contains("${"), ":param").otherwise(s)), "/")


def type_pair_score(producer: Column | str, consumer: Column | str) -> Column:
    """100 for identical paths, 95 for equal ones, 90 if parameters cover the difference, else null."""
    p, c = col(producer), col(consumer)
    a, b = segments(type_match_path(p)), segments(type_match_path(c))
    covered = F.forall(F.zip_with(a, b, lambda s, t: (s == t) | (s == ":param") | (t == ":param")), lambda ok: ok)
    return F.when(p == c, 100).when(type_match_path(p) == type_match_path(c), 95).when((F.size(a) == F.size(b)) & covered, 90)
