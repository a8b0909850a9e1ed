"""More queries over the driver's tables: verdicts by key, findings as sent, merged graphs, owners, manifests, corpus scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelake.functions import keys, paths, versions
from wirelake.operators import dependencies, findings, matching, merging, scoring, verdicts
from wirelake.plans.queries import EDGES_SQL, SITES, calls, endpoints, fnv_sql, http_sql, match, pages, pins, query, PINS_SQL
from wirelake.sources import manifests
from wirelake.sources.derived import read, with_tables

# verdicts by the key of a route and the place of the call

CHECKED = [
    "split_part(producer_key, '|', 2) as method",
    "replace(replace(split_part(producer_key, '|', 3), ':id?', '{some}'), ':id', '[other]') as identity",
    "split_part(location, ':', 1) as consumer_file",
    "case when split_part(location, ':', 2) = '1' then 0 else cast(split_part(location, ':', 2) as int) end as consumer_line",
    "case length(producer_key) % 4 when 0 then 'compatible' when 1 then 'incompatible' when 2 then 'unverifiable' else 'gate' end as kind",
    "concat(producer_key, '>', consumer_key, '@', location) as pair_key",
]
OUTCOME = ["method", "identity", "consumer_file", "consumer_line", "case when kind = 'gate' then 'incompatible' else kind end as bucket", "case when kind = 'gate' then 'baked_any' end as gate", "pair_key", "case when length(pair_key) % 3 = 0 then '' else concat('error in ', pair_key) end as diagnostic"]
CODE = "case when gate = 'baked_any' then 1 when bucket = 'compatible' then 0 when bucket = 'unverifiable' then 1 when bucket = 'incompatible' then 2 end"

def compat_sql(path: str) -> str:
    one = "case when starts_with(q, ':') or (starts_with(q, '{') and ends_with(q, '}')) or (starts_with(q, '[') and ends_with(q, ']')) then ':param' else q end"
    return f"array_to_string(list_transform(string_split({path}, '/'), lambda q: {one}), '/')"


def checked(edges):
    return edges.where("length(consumer_key) % 3 <> 0").selectExpr(*CHECKED).selectExpr(*OUTCOME)


CHECKED_SQL = EDGES_SQL + f""", checked as (select {', '.join(CHECKED)} from edges where length(consumer_key) % 3 <> 0), outcomes as (select {', '.join(OUTCOME)} from checked)"""


@query(
    "verdict_join",
    http_sql(
        CHECKED_SQL
        + f""", o as (select upper(method) as m, {compat_sql('identity')} as p, consumer_file as f, greatest(consumer_line, 1) as l, max({CODE}) as code,
  arg_min(case when diagnostic = '' then 'producer and consumer types are incompatible' else diagnostic end, pair_key) filter ({CODE} = 2) as reason from outcomes group by 1, 2, 3, 4),
j as (select e.*, case when relationship = 'producer_consumer' then code end as code, o.reason as r from edges e
  left join o on o.m = upper(split_part(producer_key, '|', 2)) and o.p = {compat_sql("split_part(producer_key, '|', 3)")} and o.f = split_part(location, ':', 1) and o.l = split_part(location, ':', 2)::int)
select producer, producer_key, consumer, consumer_key, location, relationship, case code when 0 then 'compatible' when 1 then 'unverifiable' when 2 then 'incompatible' end as verdict,
  case code when 0 then true when 2 then false end as compatible, case when code = 2 then r end as reason from j"""
    ),
)
def verdict_join(spark, sf_dir):
    edges = matching.http_edges(match(spark, sf_dir)).drop("agreement")
    return verdicts.overlay_edges(edges, checked(edges))


@query("outcome_default", "select o_orderkey as pair_key, case when o_orderkey % 5 = 0 then 'unverifiable' else 'compatible' end as bucket, case when o_orderkey % 5 = 0 then 'the check returned no verdict for this pair' end as diagnostic from orders")
def outcome_default(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    outcomes = o.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey as pair_key", "'compatible' as bucket", "cast(null as string) as gate", "cast(null as string) as diagnostic")
    return verdicts.with_missing_outcomes(o.selectExpr("o_orderkey as pair_key"), outcomes).select("pair_key", "bucket", "diagnostic")


@query(
    "producer_provenance",
    with_tables(
        f""" select call_id, case when (select min(prov) from endpoints e where upper(e.method) = upper(c.method) and {compat_sql('e.full_path')} = {compat_sql('c.path')}) = 1 then 'mock' else 'route' end as provenance
from (select call_id, method, regexp_replace(regexp_extract(target_url, '(/[a-z].*)$', 1), '/[^/]*$', '/{{x}}') as path from calls) c"""
    ),
)
def producer_provenance(spark, sf_dir):
    rows = calls(spark, sf_dir).selectExpr("call_id", "method", "regexp_replace(regexp_extract(target_url, '(/[a-z].*)$', 1), '/[^/]*$', '/{x}') as path")
    return verdicts.producer_provenance(rows, endpoints(spark, sf_dir)).select("call_id", "provenance")


# findings in one shape, as sent, counted

LISTED = "list_sort(list_distinct(list(file_location)))"
ALL_FINDINGS = f""", sites as (
  select 'missing_endpoint' as kind, method, call_path as path, null as expected_method, null as env_var, null as service, null as provenance, {LISTED} as call_sites from final where route_status = 'missing' group by all
  union all select 'method_mismatch', method, path, expected, null, null, null, {LISTED} from wrong group by all
  union all select 'env_var_call', method, call_path, null, env_var, null, null, {LISTED} from routed where status = 'env_undeclared' group by all),
findings as (select *, case kind when 'method_mismatch' then 'risk' when 'missing_endpoint' then 'gap' else 'advisory' end as severity from sites)"""


def found(m: matching.HttpMatch):
    listed = lambda df: df.withColumn("call_sites", F.split("call_sites", ","))
    return findings.all_findings({
        "missing_endpoint": listed(matching.missing_endpoints(m)), "method_mismatch": listed(matching.method_mismatches(m)).withColumnRenamed("expected", "expected_method"),
        "env_var_call": listed(matching.env_var_calls(m)),
    })


@query("findings_shape", http_sql(ALL_FINDINGS + " select kind, severity, method, path, expected_method, env_var, array_to_string(call_sites, ',') as call_sites from findings"))
def findings_shape(spark, sf_dir):
    return found(match(spark, sf_dir)).select("kind", "severity", "method", "path", "expected_method", "env_var", F.array_join("call_sites", ",").alias("call_sites"))


@query(
    "findings_wire",
    http_sql(
        ALL_FINDINGS
        + """ select kind, severity, case kind when 'missing_endpoint' then json_object('kind', kind, 'severity', severity, 'method', method, 'path', path, 'service', null, 'call_sites', call_sites[1:5])
  when 'method_mismatch' then json_object('kind', kind, 'severity', severity, 'method', method, 'path', path, 'service', null, 'call_sites', call_sites[1:5], 'expected_method', expected_method)
  else json_object('kind', kind, 'severity', severity, 'method', method, 'path', path, 'env_var', env_var, 'call_sites', call_sites[1:5]) end::varchar as payload from findings"""
    ),
)
def findings_wire(spark, sf_dir):
    return findings.wire(found(match(spark, sf_dir)))


@query(
    "issue_counts",
    http_sql(
        ALL_FINDINGS
        + """ select count(*) filter (kind = 'method_mismatch') as risks, count(*) filter (kind = 'missing_endpoint') as connectivity, 0::bigint as major_dependencies, 0::bigint as unparseable_dependencies,
  count(*) filter (kind = 'env_var_call') as configuration, 0::bigint as shared_contracts, (count(*) filter (kind in ('method_mismatch', 'missing_endpoint')))::bigint as issues from findings"""
    ),
)
def issue_counts(spark, sf_dir):
    return findings.issues(findings.categories(found(match(spark, sf_dir))), True)


@query("conflict_findings", PINS_SQL + """ select package as package_name, case when count(distinct v[1]) > 1 then 'major' else 'unparseable' end as tier, case when count(distinct v[1]) > 1 then 'gap' else 'advisory' end as severity
from merged group by package having count(distinct version) > 1 and (count(*) filter (v is null) > 0 or count(distinct v[1]) > 1)""")
def conflict_findings(spark, sf_dir):
    rows = dependencies.conflicts(dependencies.merge_highest(pins(spark, sf_dir))).select(F.col("package").alias("package_name"), "tier")
    return findings.all_findings({"dependency_conflict": rows}).select("package_name", "tier", "severity")


@query("env_suggestions", http_sql(f", s as (select env_var, method, call_path as path, file_location from routed where status = 'env_undeclared') select env_var, method, path, {SITES.replace('call_sites', 'locations')} from s group by all"))
def env_suggestions(spark, sf_dir):
    return findings.env_suggestions(found(match(spark, sf_dir))).withColumn("locations", F.array_join("locations", ","))


# merged graphs

CALL_ROWS = ["l_orderkey * 8 + l_linenumber as ordinal", "concat('repo', cast(l_suppkey % 5 as string)) as repo_name", "concat('M', cast(l_suppkey % 3 as string)) as method", "concat('/', l_returnflag, '/', cast(l_partkey % 20 as string)) as target_url", "concat('src/', l_linestatus, ':', cast(l_linenumber as string)) as file_location"]
CALL_KEYS = {"merged_calls": "method, target_url, file_location", "merged_calls_by_repository": "repo_name, method, target_url, file_location"}


def first_sql(name: str) -> str:
    return f"with c as (select {', '.join(CALL_ROWS)} from lineitem) select ordinal, repo_name from (select *, row_number() over (partition by {CALL_KEYS[name]} order by ordinal) as r from c) where r = 1"


@query("merged_calls", first_sql("merged_calls"))
def merged_calls(spark, sf_dir):
    return merging.merged_calls(read(spark, sf_dir, "lineitem").selectExpr(*CALL_ROWS)).select("ordinal", "repo_name")


@query("merged_calls_by_repository", first_sql("merged_calls_by_repository"))
def merged_calls_by_repository(spark, sf_dir):
    return merging.merged_calls(read(spark, sf_dir, "lineitem").selectExpr(*CALL_ROWS), by_repository=True).select("ordinal", "repo_name")


@query("merged_mounts", "select parent, child, path_prefix, min(ordinal) as ordinal from (select 'p' || (l_suppkey % 6) as parent, 'c' || (l_partkey % 8) as child, '/' || l_returnflag as path_prefix, l_orderkey * 8 + l_linenumber as ordinal from lineitem) group by all")
def merged_mounts(spark, sf_dir):
    return merging.merged_mounts(read(spark, sf_dir, "lineitem").selectExpr("concat('p', cast(l_suppkey % 6 as string)) as parent", "concat('c', cast(l_partkey % 8 as string)) as child", "concat('/', l_returnflag) as path_prefix", "l_orderkey * 8 + l_linenumber as ordinal"))


@query("merged_nodes", "select name, arg_min(kind, ordinal) as kind from (select p_brand as name, p_type as kind, p_partkey as ordinal from part) group by name")
def merged_nodes(spark, sf_dir):
    return merging.merged_nodes(read(spark, sf_dir, "part").selectExpr("p_brand as name", "p_type as kind", "p_partkey as ordinal")).select("name", "kind")


@query(
    "merged_endpoints",
    """select ordinal from (select *, row_number() over (partition by repo_name, coalesce(service_name, ''), method, full_path order by ordinal) as r
  from (select o_orderkey as ordinal, 'repo' || (o_custkey % 7) as repo_name, case when o_custkey % 3 > 0 then 's' || (o_custkey % 3) end as service_name, o_orderpriority as method, '/' || (o_orderkey % 11) as full_path from orders)) where r = 1""",
)
def merged_endpoints(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as ordinal", "concat('repo', cast(o_custkey % 7 as string)) as repo_name", "case when o_custkey % 3 > 0 then concat('s', cast(o_custkey % 3 as string)) end as service_name", "o_orderpriority as method", "concat('/', cast(o_orderkey % 11 as string)) as full_path")
    return merging.merged_endpoints(rows).select("ordinal")


# owners, exports, operations of other protocols

OWNED = ["o_orderkey as id", "concat('r', cast(o_custkey % 4 as string)) as repo", "concat('src/f', cast(o_orderkey % 50 as string), '.ts') as file", "concat('n', cast(o_custkey % 3 as string)) as owner"]
BOUND = ["concat('r', cast(s_suppkey % 4 as string)) as repo", "concat('src/f', cast(s_suppkey * 7 % 60 as string), '.ts') as file", "case when s_suppkey % 6 > 0 then concat('n', cast(s_suppkey % 5 as string)) end as local_name", "concat('c', cast(s_suppkey as string)) as child", "s_suppkey as ordinal"]
IMPORTED = ["concat('r', cast(n_nationkey % 4 as string)) as repo", "concat('f', cast(n_nationkey % 10 as string)) as pattern", "concat('i', cast(n_nationkey % 7 as string)) as child"]
OWNERS_SQL = f"""with e as (select {', '.join(OWNED)} from orders), b as (select {', '.join(BOUND)} from supplier), i as (select {', '.join(IMPORTED)} from nation),
best as (select repo, file, case when count(distinct child) = 1 then min(child) end as child from (
  select *, max(length(pattern)) over (partition by repo, file) as top from (select distinct e.repo, e.file, i.pattern, i.child from e join i on i.repo = e.repo and contains(e.file, i.pattern))) where length(pattern) = top group by repo, file)
select id, case when (select count(*) from b where b.repo = e.repo and b.file = e.file) = 1 then (select min(child) from b where b.repo = e.repo and b.file = e.file)
  when (select count(*) from b where b.repo = e.repo and b.file = e.file) > 1 then coalesce((select arg_min(child, ordinal) from b where b.repo = e.repo and b.file = e.file and b.local_name = e.owner), owner)
  else coalesce(best.child, owner) end as resolved from e left join best using (repo, file)"""


@query("endpoint_owners", OWNERS_SQL)
def endpoint_owners(spark, sf_dir):
    t = lambda name, cols: read(spark, sf_dir, name).selectExpr(*cols)
    return merging.endpoint_owners(t("orders", OWNED), t("supplier", BOUND), t("nation", IMPORTED)).select("id", "resolved")


@query("mount_bindings", "select o_orderkey as id, case when o_custkey % 4 = 0 then 'lib' || (o_custkey % 6) end as to_file, case when o_custkey % 4 = 0 then 'router' end as exported from orders")
def mount_bindings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "concat('f', cast(o_custkey % 12 as string)) as file", "concat('c', cast(o_custkey % 12 as string)) as child", "'./lib' as import_source")
    n = read(spark, sf_dir, "nation").where("n_nationkey < 12 and n_nationkey % 4 = 0")
    return merging.mount_bindings(o, n.selectExpr("concat('f', cast(n_nationkey as string)) as file", "concat('c', cast(n_nationkey as string)) as local", "concat('lib', cast(n_nationkey % 6 as string)) as to_file", "'router' as exported")).select("id", "to_file", "exported")


@query(
    "export_closure",
    """with recursive edge as (select n_nationkey as file, (n_nationkey * 3 + 1) % 25 as to_file from nation where n_nationkey % 4 <> 3), known as (select n_nationkey as file, case when n_nationkey % 5 = 0 then 'default' else n_name end as name from nation),
reach(file, spot, hops) as (select file, to_file, 1 from edge union select r.file, e.to_file, hops + 1 from reach r join edge e on e.file = r.spot where hops < 8)
select file, name from known union select r.file, k.name from reach r join known k on k.file = r.spot where k.name <> 'default' and r.file <> r.spot""",
)
def export_closure(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    local = n.selectExpr("n_nationkey as file", "case when n_nationkey % 5 = 0 then 'default' else n_name end as name")
    return merging.export_names(local, local.limit(0), n.where("n_nationkey % 4 <> 3").selectExpr("n_nationkey as file", "(n_nationkey * 3 + 1) % 25 as to_file"))


PROTOCOL = ["concat('svc', cast(user_id % 9 as string)) as owner_id", "case event_id % 4 when 0 then 'graphql' when 1 then 'socket' else 'pubsub' end as protocol", "concat(event_type, '-', cast(user_id % 15 as string)) as key", "concat('src/', event_type, ':', cast(event_id % 60 as string)) as location", "case event_id % 5 when 0 then null when 1 then 'producer' when 2 then 'producer' else 'consumer' end as role"]


def protocol_ops(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(*PROTOCOL)


def http_ops(spark, sf_dir):
    e, c = endpoints(spark, sf_dir), calls(spark, sf_dir)
    shape = lambda df, path: df.select("owner_id", F.lit("http").alias("protocol"), F.concat_ws("|", F.lit("http"), F.upper("method"), path).alias("key"), F.col("file_location").alias("location"))
    return shape(e, "full_path"), shape(c, "target_url")


FOLDED_SQL = with_tables(f""", ops as (select {', '.join(PROTOCOL)} from events),
e2 as (select owner_id, 'http' as protocol, 'http|' || upper(method) || '|' || full_path as key, file_location as location from endpoints union all select owner_id, protocol, key, location from ops where role = 'producer'),
c2 as (select owner_id, 'http' as protocol, 'http|' || upper(method) || '|' || target_url as key, file_location as location from calls union all select owner_id, protocol, key, location from ops where role = 'consumer')""")


@query("folded_operations", FOLDED_SQL + " select 'endpoint' as side, * from e2 union all select 'call', * from c2")
def folded_operations(spark, sf_dir):
    e, c = merging.fold_operations(*http_ops(spark, sf_dir), protocol_ops(spark, sf_dir))
    return e.withColumn("side", F.lit("endpoint")).unionByName(c.withColumn("side", F.lit("call")))


@query("index_statistics", FOLDED_SQL + " select (select count(*) from e2) as endpoints, (select count(*) from c2) as calls, (select count(distinct owner_id) from (select owner_id from e2 union all select owner_id from c2)) as services, exists (select 1 from ops where protocol = 'graphql' and role is not null) as any_graphql")
def index_statistics(spark, sf_dir):
    return merging.statistics(*merging.fold_operations(*http_ops(spark, sf_dir), protocol_ops(spark, sf_dir)))


@query(
    "protocol_manifest",
    f"""with ops as (select {', '.join(PROTOCOL)} from events where event_id % 5 <> 0), placed as (select distinct owner_id, key, role, 'response' as type_kind, location as call_id from ops where role = 'consumer' or protocol = 'pubsub')
select * from placed union select distinct owner_id, key, role, 'response', null from ops where role = 'producer' and protocol <> 'pubsub'""",
)
def protocol_manifest(spark, sf_dir):
    return merging.protocol_manifest(protocol_ops(spark, sf_dir))


@query(
    "symbol_stamps",
    """with m as (select p_partkey as id, 'f' || (p_partkey % 20) as file, greatest(p_size % 15, 1) as line, case when p_partkey % 4 = 0 then 'Own' end as symbol from part),
k as (select 'f' || (o_custkey % 25) as file, greatest(o_orderkey % 12, 1) as line, o_custkey % 2 as side, case when o_orderkey % 3 > 0 then 'T' || (o_orderkey % 7) end as symbol, o_orderkey as ordinal from orders),
f as (select file, line, arg_min(symbol, {'side': side, 'ordinal': ordinal}) as stamped from k where symbol is not null group by all)
select id, coalesce(stamped, symbol) as symbol from m left join f using (file, line)""",
)
def symbol_stamps(spark, sf_dir):
    m = read(spark, sf_dir, "part").selectExpr("p_partkey as id", "concat('f', cast(p_partkey % 20 as string)) as file", "greatest(p_size % 15, 1) as line", "case when p_partkey % 4 = 0 then 'Own' end as symbol")
    o = read(spark, sf_dir, "orders").selectExpr("concat('f', cast(o_custkey % 25 as string)) as file", "cast(o_orderkey % 12 as int) as line", "o_custkey % 2 as side", "case when o_orderkey % 3 > 0 then concat('T', cast(o_orderkey % 7 as string)) end as symbol", "o_orderkey as ordinal")
    return merging.stamp_symbols(m, o.where("side = 0").drop("side"), o.where("side = 1").drop("side")).select("id", "symbol")


REMOVED = ["page_id as id", "case page_id % 2 when 0 then 'GET' else 'post' end as method", "concat('/', seg1, case page_id % 3 when 0 then '/:id' when 1 then '/{x}?' else '/list' end) as path"]
LOST = ["case page_id % 3 when 0 then 'get' else 'POST' end as method", "concat('/', seg1, case page_id % 5 when 0 then '/:param' else '/list' end) as path"]
CLIENT = ["'GET' as method", "concat('/', seg1, '/<id>') as path", "concat('pkg', cast(page_id % 3 as string)) as package", "host as consumer"]


@query(
    "delta_flags",
    with_tables(
        f""", r as (select {', '.join(REMOVED)} from p), l as (select distinct {', '.join(LOST)} from p where page_id % 4 = 1), s as (select distinct {', '.join(CLIENT)} from p where page_id % 4 = 2)
select r.id, coalesce(bool_or({{}}), false) as still_consumed, null as x from r left join l on upper(l.method) = upper(r.method) group by r.id""".replace("{}", "len(string_split(r.path, '/')) = len(string_split(l.path, '/')) and string_split(r.path, '/')[2] = string_split(l.path, '/')[2] and (r.path like '%/:id' or r.path like '%}?' or l.path like '%/:param' or r.path = l.path)").replace(", null as x", "")
    ),
)
def delta_flags(spark, sf_dir):
    p = pages(spark, sf_dir)
    out = merging.delta_flags(p.selectExpr(*REMOVED), p.where("page_id % 4 = 1").selectExpr(*LOST).distinct(), p.where("page_id % 4 = 2").selectExpr(*CLIENT).distinct())
    return out.select("id", "still_consumed")


@query(
    "delta_clients",
    with_tables(
        f""", r as (select {', '.join(REMOVED)} from p), s as (select distinct {', '.join(CLIENT)} from p where page_id % 4 = 2)
select r.id, array_to_string(list_sort(list_distinct(list(package))), ',') as packages, array_to_string(list_sort(list_distinct(list(consumer))), ',') as consumers
from r join s on upper(r.method) = 'GET' and string_split(r.path, '/')[2] = string_split(s.path, '/')[2] group by r.id"""
    ),
)
def delta_clients(spark, sf_dir):
    p = pages(spark, sf_dir)
    out = merging.delta_flags(p.selectExpr(*REMOVED), p.where("page_id % 4 = 1").selectExpr(*LOST).distinct(), p.where("page_id % 4 = 2").selectExpr(*CLIENT).distinct())
    return out.where("packages is not null").select("id", F.array_join("packages", ",").alias("packages"), F.array_join("consumers", ",").alias("consumers"))


# GraphQL claims, handlers

CLAIMS = ["concat('q', cast(l_orderkey % 40 as string)) as key", "concat('f', cast(l_partkey % 3 as string)) as file", "concat('fn', cast(l_suppkey % 4 as string)) as function", "case when l_linenumber % 3 = 0 then 'resolver' else 'type' end as kind"]


@query(
    "resolver_locations",
    f"""with c as (select {', '.join(CLAIMS)} from lineitem where l_orderkey % 7 = 0 and l_linenumber > 4), open as (select * from c where (file, function) not in (values ('f1', 'fn2'), ('f0', 'fn1'))),
b as (select * from open where (kind = 'resolver') = (select bool_or(kind = 'resolver') from open o where o.key = open.key)),
a as (select key, min(file) as file, min(function) as function from b group by key having count(distinct (file, function)) = 1),
ops as (select 'q' || i as key from range(40) t(i)) select key, file, function from ops left join a using (key)""",
)
def resolver_locations(spark, sf_dir):
    claims = read(spark, sf_dir, "lineitem").where("l_orderkey % 7 = 0 and l_linenumber > 4").selectExpr(*CLAIMS)
    handlers = spark.createDataFrame([("f1", "fn2"), ("f0", "fn1")], "file string, handler string")
    return merging.resolver_locations(spark.range(40).selectExpr("concat('q', cast(id as string)) as key"), claims, handlers)


@query("observed_fields", "select o_orderkey as key, s_name as response_fields, s_acctbal as request_fields from orders left join supplier on s_suppkey = o_custkey % 200")
def observed_fields(spark, sf_dir):
    e = read(spark, sf_dir, "orders").selectExpr("o_orderkey as key", "concat('h', cast(o_custkey % 200 as string)) as handler", "'lib' as from_file")
    f = read(spark, sf_dir, "supplier").selectExpr("'lib' as file", "concat('h', cast(s_suppkey as string)) as name", "s_name as response_fields", "s_acctbal as request_fields")
    return merging.observed_fields(e, f).select("key", "response_fields", "request_fields")


# keys, names, versions

def fnv64(text: str) -> str:
    return fnv_sql(text, 1099511628211, 14695981039346656037, 64)


ALIAS_KEY = "concat('http|', upper(method), '|', full_path)"


@query(
    "type_alias_keys",
    with_tables(f" select ordinal, 'Endpoint_' || {fnv64(ALIAS_KEY + " || '|producer|Response'")} || '_Response' as alias, {fnv64("file_location || '|7|' || " + ALIAS_KEY)} as call_id from endpoints"),
)
def type_alias_keys(spark, sf_dir):
    e = endpoints(spark, sf_dir).withColumn("key", F.concat_ws("|", F.lit("http"), F.upper("method"), "full_path"))
    site = keys.call_site_id(F.concat(F.lit("/work/repo/./"), "file_location"), F.lit(7), "key", F.lit("/work/repo/"))
    return e.select("ordinal", keys.type_alias("key", F.lit("producer"), F.lit("Response")).alias("alias"), site.alias("call_id"))


KEYS = "case page_id % 6 when 0 then 'http|get|/a|b' when 1 then 'graphql|query|' || label when 2 then 'socket|emit|' || label when 3 then 'pubsub|' || label when 4 then 'pubsub|a|b' else 'http||/x' end"


@query(
    "key_labels",
    with_tables(
        f""", k as (select page_id, label, {KEYS} as key from p) select page_id, case page_id % 6 when 0 then 'GET' when 1 then 'GRAPHQL' when 2 then 'SOCKET' when 3 then 'PUBSUB' end as method,
  case page_id % 6 when 0 then '/a|b' when 1 then 'query|' || label when 2 then 'emit|' || label when 3 then label end as identity,
  case page_id % 6 when 0 then 'get' when 1 then 'QUERY' when 2 then 'emit' when 3 then 'PUBSUB' end as label, case page_id % 6 when 0 then '/a|b' when 1 then label when 2 then label when 3 then label end as name from k"""
    ),
)
def key_labels(spark, sf_dir):
    k = pages(spark, sf_dir).selectExpr("page_id", KEYS.replace("||", "@@").replace(" @@ label", "").replace("@@", "||") + " as bare", "label as tag")
    k = k.withColumn("key", F.when(F.col("page_id") % 6 == 1, F.concat(F.lit("graphql|query|"), "tag")).when(F.col("page_id") % 6 == 2, F.concat(F.lit("socket|emit|"), "tag")).when(F.col("page_id") % 6 == 3, F.concat(F.lit("pubsub|"), "tag")).otherwise(F.col("bare")))
    return k.withColumns({"v": keys.verdict_key("key"), "d": keys.display_labels("key")}).select("page_id", "v.method", "v.identity", "d.label", "d.name")


VERSION = "concat(cast({0} % 3 as string), '.', cast({0} % 2 as string), '.0', case {0} % 5 when 0 then '' when 1 then concat('-rc.', cast({0} % 13 as string)) when 2 then '-rc' when 3 then '-alpha.b' else concat('-', cast({0} % 17 as string)) end)"
PRE = "case {0} % 5 when 0 then [[2, 0, '']] when 1 then [[1, 0, 'rc'], [0, 0, lpad(({0} % 13)::varchar, 3, '0')]] when 2 then [[1, 0, 'rc']] when 3 then [[1, 0, 'alpha'], [1, 0, 'b']] else [[0, 0, lpad(({0} % 17)::varchar, 3, '0')]] end"


@query(
    "version_order",
    "with v as (select n_nationkey as a, m as b from nation, range(40) t(m)) select a, b, "
    + "(a % 3, a % 2, " + PRE.replace("0, '", "'").replace("0, lpad", "lpad").replace("[2, ''", "['2', ''").replace("[1, '", "['1', '").replace("[0, lpad", "['0', lpad").format("a") + ") < (b % 3, b % 2, "
    + PRE.replace("0, '", "'").replace("0, lpad", "lpad").replace("[2, ''", "['2', ''").replace("[1, '", "['1', '").replace("[0, lpad", "['0', lpad").format("b") + ") as below from v",
)
def version_order(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.explode(F.expr("sequence(0L, 39L)")).alias("b"))
    v = lambda c: versions.semver(F.expr(VERSION.format(c)))
    return rows.select("a", "b", (v("a") < v("b")).alias("below"))


@query("prefix_joins", with_tables(" select ordinal, rtrim(seg, '/') || case when rest = '' then '' else '/' || rest end as joined from (select ordinal, split_part(full_path, '/', 2) || '//' as seg, ltrim(split_part(full_path, '/', 3), '/') as rest from endpoints)"))
def prefix_joins(spark, sf_dir):
    e = endpoints(spark, sf_dir).selectExpr("ordinal", "concat(split_part(full_path, '/', 2), '//') as prefix", "concat('/', split_part(full_path, '/', 3)) as path")
    return e.select("ordinal", paths.join_prefix("prefix", "path").alias("joined"))


@query("scoring_keys", with_tables(f" select ordinal, 'http|' || upper(method) || '|' || case when length(q) > 1 and q like '%/' then left(q, length(q) - 1) else q end as key from (select *, {compat_sql('full_path')} as q from endpoints)"))
def scoring_keys(spark, sf_dir):
    e = endpoints(spark, sf_dir)
    return e.select("ordinal", keys.scoring_key(F.concat_ws("|", F.lit("http"), F.lower("method"), "full_path")).alias("key"))


@query("type_names", with_tables(" select page_id, array_to_string(list_transform(list_filter(string_split(regexp_replace('/' || seg1 || '/' || tail || '?x=1', '\\?.*$', ''), '/'), lambda s: s <> ''), lambda s: array_to_string(list_transform(list_filter(regexp_split_to_array(s, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')), '') as name from p"))
def type_names(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", keys.type_name(F.concat(F.lit("/"), "seg1", F.lit("/"), "tail", F.lit("?x=1"))).alias("name"))


@query("probable_urls", with_tables(" select call_id, case when length(target_url) > 20 then left(target_url, 17) || '...' else target_url end as short from calls"))
def probable_urls(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", keys.truncated("target_url", 20).alias("short"))


# manifests, configurations, memos

TEXT = "concat('{{\"name\":\"pkg', cast({0} % 30 as string), '\",\"version\":\"1.', cast({0} % 4 as string), '.0\",\"dependencies\":{{\"dep', cast({0} % 9 as string), '\":\"^2.0.0\"}}}}')".format("s_suppkey")
FILES = ["concat('r', cast(s_suppkey % 6 as string)) as repo", "concat('packages/', cast(s_suppkey as string), '/package.json') as path", f"{TEXT} as text"]


@query("manifest_files", "select 'packages/' || s_suppkey || '/package.json' as path, 'pkg' || (s_suppkey % 30) as name, '1.' || (s_suppkey % 4) || '.0' as version, 'dep' || (s_suppkey % 9) as dependency, '^2.0.0' as spec from supplier")
def manifest_files(spark, sf_dir):
    rows = manifests.read_manifests(read(spark, sf_dir, "supplier").selectExpr(*FILES))
    return rows.select("path", "name", "version", F.explode("dependencies").alias("dependency", "spec"))


@query("internal_names", "select distinct 'pkg' || (s_suppkey % 30) as name from supplier")
def internal_names(spark, sf_dir):
    return manifests.internal_names(read(spark, sf_dir, "supplier").selectExpr(*FILES))


@query(
    "manifests_hash",
    f"""with f as (select {', '.join(FILES)} from supplier) select repo, sha256(string_agg(path || chr(0) || text || chr(0), '' order by path)) as hash, true as reusable from f group by repo""",
)
def manifests_hash(spark, sf_dir):
    files = read(spark, sf_dir, "supplier").selectExpr(*FILES)
    now = manifests.manifests_hash(files, ["repo"])
    same = manifests.reusable(now.withColumn("result", F.lit(1)), now, ["repo"])
    return now.join(same.select("repo", F.lit(True).alias("reusable")), "repo", "left")


CONFIGS = "case n_nationkey % 3 when 0 then concat('{\"serviceName\":\"s', cast(n_nationkey as string), '\",\"internalEnvVars\":[\"A', cast(n_regionkey as string), '\"]}') when 1 then concat('{\"serviceName\":\"gone\",\"services\":[{\"name\":\"x', cast(n_nationkey as string), '\",\"directory\":\"d\",\"internalDomains\":[\"', lower(n_name), '.io\"]},{\"name\":\"y\",\"externalEnvVars\":[\"B\"]}]}') else '{}' end"


@query(
    "config_services",
    """select n_nationkey as path, 0 as place, case n_nationkey % 3 when 0 then 's' || n_nationkey when 1 then 'x' || n_nationkey end as service, case when n_nationkey % 3 = 1 then 'd' end as directory,
  case when n_nationkey % 3 = 0 then 'A' || n_regionkey else '' end as internal_env, case when n_nationkey % 3 = 1 then lower(n_name) || '.io' else '' end as internal_domains, '' as external_env from nation
union all select n_nationkey, 1, 'y', null, '', '', 'B' from nation where n_nationkey % 3 = 1""",
)
def config_services(spark, sf_dir):
    rows = manifests.read_services(read(spark, sf_dir, "nation").selectExpr("n_nationkey as path", f"{CONFIGS} as text"))
    flat = lambda c: F.array_join(c, ",")
    return rows.select("path", "place", "service", "directory", flat("internalEnvVars").alias("internal_env"), flat("internalDomains").alias("internal_domains"), flat("externalEnvVars").alias("external_env"))


@query("config_union", "select 's0' as service, array_to_string(list_sort(list_distinct(list('A' || n_regionkey) filter (n_nationkey % 3 = 0))), ',') as internal_env, 'B' as external_env, array_to_string(list_sort(list(lower(n_name) || '.io') filter (n_nationkey % 3 = 1)), ',') as internal_domains from nation")
def config_union(spark, sf_dir):
    one = manifests.merge_services(manifests.read_services(read(spark, sf_dir, "nation").selectExpr("n_nationkey as path", f"{CONFIGS} as text")))
    return one.select("service", F.array_join("internalEnvVars", ",").alias("internal_env"), F.array_join("externalEnvVars", ",").alias("external_env"), F.array_join("internalDomains", ",").alias("internal_domains"))


@query("intent_memo", "select o_orderkey as id, case when o_custkey % 10 < 5 then 'intent ' || (o_custkey % 10) end as intent from orders")
def intent_memo(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "sha2(cast(o_custkey % 10 as string), 256) as content_hash")
    memo = spark.range(10).selectExpr("sha2(cast(id as string), 256) as content_hash", "case when id < 5 then concat('intent ', cast(id as string)) end as intent")
    return manifests.remembered(o, memo).select("id", "intent")


# corpus scores

EDGE = ["concat('svc', cast(l_suppkey % 4 as string)) as producer_repo", "concat('http|get|/o/:id', cast(l_linenumber as string), '/x', cast(l_partkey % 6 as string), '/') as producer_key", "concat('repo', cast(l_partkey % 3 as string)) as consumer_repo", "concat('http|GET|/o/{k}/', cast(l_partkey % 6 as string)) as consumer_key"]
LABEL = ["case l_suppkey % 5 when 0 then 'svc0' else concat('repo', cast(l_suppkey % 4 as string)) end as producer_repo", "concat('http|GET|/o/[z]/x', cast(l_partkey % 6 as string)) as producer_key", "concat('repo', cast(l_partkey % 3 as string)) as consumer_repo", "concat('http|get|/o/:m/', cast(l_partkey % 6 as string)) as consumer_key", "case when l_partkey % 4 = 0 then 'roadmap' else 'capability' end as tier", "case l_partkey % 6 when 0 then null when 1 then false else true end as type_compatible"]
FOLD = "case when {0} like 'svc%' then 'repo' || substr({0}, 4) else {0} end"


def norm_sql(key: str) -> str:
    q = compat_sql(f"array_to_string(list_slice(string_split({key}, '|'), 3, 99), '|')")
    return f"split_part({key}, '|', 1) || '|' || upper(split_part({key}, '|', 2)) || '|' || rtrim({q}, '/')"


def edge_sql(name: str) -> str:
    return f"{FOLD.format('producer_repo')} as producer_repo, {norm_sql('producer_key')} as producer_key, {FOLD.format('consumer_repo')} as consumer_repo, {norm_sql('consumer_key')} as consumer_key from {name}"


CORPUS = f"""with f0 as (select {', '.join(EDGE)}, l_partkey % 2 = 0 as type_compatible from lineitem where l_orderkey % 3 = 0 and l_linenumber < 3), x0 as (select distinct {', '.join(LABEL)} from lineitem where l_orderkey % 5 = 0),
f1 as (select distinct type_compatible, {edge_sql('f0')}), x1 as (select distinct tier, type_compatible, {edge_sql('x0')}), x as (select distinct tier, producer_repo, producer_key, consumer_repo, consumer_key from x1),
f as (select distinct producer_repo, producer_key, consumer_repo, consumer_key from f1)"""
SCORES = """ select tier, hits, found, expected, precision, recall, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from (
  select tier, hits, found, expected, case when found = 0 then (case when expected = 0 then 1.0 else 0.0 end) else hits / found end as precision, case when expected = 0 then 1.0 else hits / expected end as recall from (
    select tier, sum(h)::bigint as hits, sum(f)::bigint as found, sum(e)::bigint as expected from sides group by tier))"""


def corpus(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    aliases = spark.range(4).selectExpr("concat('svc', cast(id as string)) as service", "concat('repo', cast(id as string)) as repo")
    f = l.where("l_orderkey % 3 = 0 and l_linenumber < 3").selectExpr(*EDGE, "l_partkey % 2 = 0 as type_compatible")
    return f, l.where("l_orderkey % 5 = 0").selectExpr(*LABEL).distinct(), aliases


@query("match_scores", CORPUS + ", sides as (select coalesce(x.tier, 'capability') as tier, (x.tier is not null)::int as h, 1 as f, 0 as e from f left join x using (producer_repo, producer_key, consumer_repo, consumer_key) union all select tier, 0, 0, 1 from x)" + SCORES)
def match_scores(spark, sf_dir):
    return scoring.match_scores(*corpus(spark, sf_dir))


@query(
    "compat_accuracy",
    CORPUS + """, s as (select *, max(type_compatible) as seen from f1 group by all), one as (select producer_repo, producer_key, consumer_repo, consumer_key, bool_or(type_compatible) as seen from f1 group by 1, 2, 3, 4),
j as (select x1.tier, x1.type_compatible as want, one.seen, one.producer_repo is not null and x1.type_compatible is not null as scored from x1 left join one using (producer_repo, producer_key, consumer_repo, consumer_key))
select tier, count(*) filter (scored and seen = want) as correct, count(*) filter (scored) as total, case when count(*) filter (scored) = 0 then 1.0 else count(*) filter (scored and seen = want) / count(*) filter (scored) end as accuracy from j group by tier""".replace("s as (select *, max(type_compatible) as seen from f1 group by all), ", ""),
)
def compat_accuracy(spark, sf_dir):
    f, x, aliases = corpus(spark, sf_dir)
    return scoring.compat_accuracy(scoring.folded(f, aliases), scoring.folded(x, aliases).distinct())


@query("orphan_scores", CORPUS + f""", wanted as (select distinct 'capability' as tier, 'repo' || (p_partkey % 5) as repo, case when p_size % 2 = 0 then 'producer' else 'consumer' end as side, 'http|GET|/o/:param/' || case when p_size % 2 = 0 then 'x' else '' end || (p_partkey % 9) as key from part),
ends as (select producer_repo as repo, 'producer' as side, producer_key as key from f union select consumer_repo, 'consumer', consumer_key from f),
c as (select tier, count(*) filter (not exists (select 1 from ends e where e.repo = w.repo and e.side = w.side and e.key = w.key)) as hits, count(*) as expected from wanted w group by tier)
select tier, hits, expected, case when hits = 0 then 0.0 else 1.0 end as precision, hits / expected as recall, case when hits = 0 then 0.0 else 2 * (hits / expected) / (1 + hits / expected) end as f1 from c""")
def orphan_scores(spark, sf_dir):
    f, _, aliases = corpus(spark, sf_dir)
    wanted = read(spark, sf_dir, "part").selectExpr("'capability' as tier", "concat('repo', cast(p_partkey % 5 as string)) as repo", "case when p_size % 2 = 0 then 'producer' else 'consumer' end as side", "concat('http|get|/o/:k/', case when p_size % 2 = 0 then 'x' else '' end, cast(p_partkey % 9 as string)) as key")
    return scoring.orphan_scores(wanted, scoring.folded(f, aliases))


@query("conflict_scores", """with f as (select distinct p_brand as package, array_to_string(list_sort([p_size::varchar, 'b']), ',') as versions, 'critical' as severity from part where p_partkey % 2 = 0),
x as (select distinct case when p_size % 3 = 0 then 'roadmap' else 'capability' end as tier, p_brand as package, array_to_string(list_sort([p_size::varchar, 'b']), ',') as versions, 'critical' as severity from part where p_partkey % 3 = 0),
sides as (select coalesce(x.tier, 'capability') as tier, (x.tier is not null)::int as h, 1 as f, 0 as e from f left join x using (package, versions, severity) union all select tier, 0, 0, 1 from x)""" + SCORES)
def conflict_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand as package", "p_size", "case when p_size % 3 = 0 then 'roadmap' else 'capability' end as tier", "'critical' as severity")
    f = rows.where("p_partkey % 2 = 0").withColumn("versions", F.array(F.lit("b"), F.col("p_size").cast("string")))
    x = rows.where("p_partkey % 3 = 0").withColumn("versions", F.array(F.col("p_size").cast("string"), F.lit("b")))
    return scoring.conflict_scores(f, x)


@query("join_diagnosis", CORPUS + """ select (select count(*) from x)::bigint as labelled, (select count(*) from f)::bigint as predicted, (select array_to_string(list_sort(list_distinct(list(r))), ', ') from (select unnest([producer_repo, consumer_repo]) as r from x)) as label_repos,
  (select array_to_string(list_sort(list_distinct(list(r))), ', ') from (select 'z-' || unnest([producer_repo, consumer_repo]) as r from f)) as found_repos""")
def join_diagnosis(spark, sf_dir):
    f, x, aliases = corpus(spark, sf_dir)
    found_edges = scoring.folded(f, aliases).select(*scoring.EDGE).distinct().withColumns({c: F.concat(F.lit("z-"), c) for c in ("producer_repo", "consumer_repo")})
    return scoring.join_diagnosis(found_edges, scoring.folded(x, aliases).select("tier", *scoring.EDGE).distinct())


@query("overall_scores", "select n_nationkey as run, (n_nationkey / 25 + n_regionkey / 5 + case when n_nationkey % 2 = 0 then 0.5 else 0 end) / (2 + (n_nationkey % 2 = 0)::int) as overall from nation")
def overall_scores(spark, sf_dir):
    runs = read(spark, sf_dir, "nation").selectExpr("n_nationkey as run", "n_nationkey / 25 as a", "n_regionkey / 5 as b", "0.5d as c", "n_nationkey % 2 = 0 as scored")
    return scoring.overall(runs, ["a", "b"], "c", "scored").select("run", "overall")


@query("owner_accuracy", "select count(*) filter (o_orderkey % 4 <> 1) as correct, count(*) as total, count(*) filter (o_orderkey % 4 <> 1) / count(*) as accuracy from orders where o_orderkey % 3 = 0")
def owner_accuracy(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    owner = "case o_orderkey % 4 when 0 then null when 1 then 'a  b' else concat('own ', cast(o_custkey as string)) end as owner"
    seen = "case o_orderkey % 4 when 0 then null when 1 then 'ab' else concat(' own  ', cast(o_custkey as string)) end as owner"
    return scoring.field_accuracy(o.selectExpr("o_orderkey as key", seen), o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey as key", owner), ["key"], "owner")


@query("call_blend", """with c as (select count(*) filter (n_nationkey % 3 = 0 and n_nationkey % 2 = 0) + 4 as hits, count(*) filter (n_nationkey % 2 = 0) + 5 as found, count(*) filter (n_nationkey % 3 = 0) + 4 as expected from nation)
select hits::bigint as hits, found::bigint as found, expected::bigint as expected, hits / found as precision, hits / expected as recall, 2 * (hits / found) * (hits / expected) / (hits / found + hits / expected) as f1 from c""")
def call_blend(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    http = n.selectExpr("n_nationkey % 3 = 0 and n_nationkey % 2 = 0 as hit", "n_nationkey % 2 = 0 as found", "n_nationkey % 3 = 0 as expected")
    return scoring.call_blend(http, n.selectExpr("n_regionkey as key"), n.where("n_regionkey < 4").selectExpr("n_regionkey as key"), ["key"])
