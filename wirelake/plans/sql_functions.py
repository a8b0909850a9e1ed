"""Path functions for SQL text: temporary functions with SQL bodies, so queries written as text stay in the optimizer's reach."""

from __future__ import annotations

from pyspark.sql import SparkSession

PARAM = r"'(?s)^(:.*|\\{.*\\}|<.*>|\\[.*\\])$'"
BLANK = r"'^\\s*$'"


def literal(seg: str) -> str:
    return f"(NOT {seg} RLIKE {BLANK} AND NOT {seg} RLIKE {PARAM} AND {seg} NOT IN ('*', '**', '(.*)'))"


def bare(seg: str) -> str:
    return rf"regexp_replace({seg}, '\\?+$', '')"


def specificity(path: str) -> str:
    return f"size(filter(split({path}, '/', -1), s -> {literal(bare('s'))}))"


def catch_all(path: str) -> str:
    return f"(endswith({path}, '/*') OR endswith({path}, '/**') OR endswith({path}, '/(.*)'))"


def prefix(path: str) -> str:
    stars = rf"regexp_replace(regexp_replace({path}, '(/\\*\\*)+$', ''), '(/\\*)+$', '')"
    return rf"if(endswith({path}, '/(.*)'), regexp_replace({path}, '(/\\(\\.\\*\\))+$', ''), {stars})"


def summed(codes: str) -> str:
    """The sum of the codes, null if one is negative."""
    return f"get(transform(array({codes}), k -> if(exists(k, x -> x < 0), null, aggregate(k, 0, (a, x) -> a + x))), 0)"


def agreement(e: str, c: str) -> str:
    es, cs, own = f"split({e}, '/', -1)", f"split({c}, '/', -1)", bare("s")
    params = (
        f"CASE WHEN t IS NULL THEN if(endswith(s, '?'), 0, -1) WHEN {own} RLIKE {PARAM} OR t RLIKE {PARAM} THEN if({own} RLIKE {BLANK} OR t RLIKE {BLANK}, -1, 0) "
        f"WHEN {own} <> t THEN -1 ELSE cast({literal(own)} AS int) END"
    )
    wild = f"CASE WHEN s = '*' THEN 0 WHEN s <> t THEN -1 ELSE cast({literal('s')} AS int) END"
    needed = f"size(filter({es}, s -> NOT endswith(s, '?')))"
    return (
        f"coalesce(if({e} = {c}, {specificity(e)}, null), if(size({cs}) BETWEEN {needed} AND size({es}), {summed(f'zip_with({es}, {cs}, (s, t) -> {params})')}, null), "
        f"CASE WHEN {catch_all(e)} THEN if({c} = {prefix(e)} OR startswith({c}, concat({prefix(e)}, '/')), {specificity(prefix(e))}, null) "
        f"WHEN size({es}) = size({cs}) THEN {summed(f'zip_with({es}, {cs}, (s, t) -> {wild})')} END)"
    )


FUNCTIONS = {
    "is_param_segment(s STRING)": ("BOOLEAN", f"s RLIKE {PARAM}"),
    "path_literal_specificity(p STRING)": ("INT", specificity("p")),
    "is_catch_all_path(p STRING)": ("BOOLEAN", catch_all("p")),
    "match_agreement(e STRING, c STRING)": ("INT", agreement("e", "c")),
    "paths_match(e STRING, c STRING)": ("BOOLEAN", f"({agreement('e', 'c')}) IS NOT NULL"),
    "classify_relationship(evidence STRING)": ("STRING", "if(evidence = 'call_site', 'shared_external_contract', 'producer_consumer')"),
}


def register(spark: SparkSession) -> None:
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
