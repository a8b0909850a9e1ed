"""Queries over captured types, candidates, sockets, stubs, messages, payloads and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelake.functions import keys, paths
from wirelake.operators import findings, matching, merging, records, scoring
from wirelake.plans import oracle as o
from wirelake.plans import sql_functions
from wirelake.plans.contract_queries import ALL_FINDINGS, found, http_ops
from wirelake.plans.queries import EDGES_SQL, calls, endpoints, http_sql, match, query
from wirelake.sources.derived import read, with_tables

TEXTS = ["concat('a', cast(o_custkey % 40 as string)) as alias", "case o_orderkey % 6 when 0 then '' when 1 then 'interface X {}' when 2 then 'any' else concat(' T', cast(o_orderkey as string), '[] ') end as text", "o_orderkey as ordinal"]


@query(
    "backfill_texts",
    f"""with t as (select {', '.join(TEXTS)}, o_orderkey % 2 as source from orders), u as (select alias, trim(text) as text, source, ordinal from t where trim(text) not in ('', 'any') and not starts_with(trim(text), 'interface '))
select alias, arg_min(text, {{'a': source, 'b': ordinal}}) as text from u group by alias""",
)
def backfill_texts(spark, sf_dir):
    t = read(spark, sf_dir, "orders").selectExpr(*TEXTS, "o_orderkey % 2 as source")
    return records.backfill_texts(t.where("source = 0"), t.where("source = 1"))


@query(
    "backfill_anchors",
    """select p_partkey as id, case when p_partkey % 3 = 0 and p_partkey % 4 <> 0 and p_partkey % 5 = 0 then 'literal' else 'locator' end as kind,
  case when p_partkey % 3 = 0 and p_partkey % 4 <> 0 and p_partkey % 5 = 0 then 'T' end as text, case when p_partkey % 3 = 0 and p_partkey % 4 <> 0 and p_partkey % 5 = 0 then 'anchor-backfill' else 'scan' end as origin from part""",
)
def backfill_anchors(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.selectExpr("p_partkey as alias", "case when p_partkey % 3 = 0 then 'lost' end as failure", "case when p_partkey % 4 = 0 then 'literal' else 'locator' end as anchor_kind")
    anchors = p.selectExpr("p_partkey as alias", "'locator' as kind", "cast(null as string) as text", "'scan' as origin")
    return records.backfilled_anchors(anchors, rows, p.where("p_partkey % 5 = 0").selectExpr("p_partkey as alias", "'T' as text")).withColumnRenamed("alias", "id")


@query("backfill_accepted", "select x as worst, x < 0 as accepted from (values (-1), (7)) t(x)")
def backfill_accepted(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    state = lambda failed: p.selectExpr("p_partkey as alias", f"case when {failed} then 'lost' end as failure", f"case when {failed} then 'failed' else 'ok' end as self_check", "false as top", "cast(null as string) as deep")
    wanted = p.where("p_partkey % 5 = 0").selectExpr("p_partkey as alias")
    out = None
    for worst in (-1, 7):
        rows = records.backfill_accepted(wanted, state("p_partkey % 5 = 0"), state(f"p_partkey = {worst}")).select(F.lit(worst).alias("worst"), "accepted")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "candidate_rows",
    "select 'endpoint' as side, o_orderkey as id, o_orderkey % 90 as line, o_orderkey * 3 as span from orders where o_orderkey % 4 = 0 union all select 'call', o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey % 90 else -1 end, case when o_orderkey % 4 = 0 then o_orderkey * 3 end from orders where o_custkey % 2 = 0",
)
def candidate_rows(spark, sf_dir):
    r = read(spark, sf_dir, "orders")
    rows = r.selectExpr("o_orderkey as id", "o_orderkey as candidate_id", "-1L as line", "o_custkey")
    known = r.where("o_orderkey % 4 = 0").selectExpr("o_orderkey as candidate_id", "o_orderkey % 90 as at", "o_orderkey * 3 as span")
    e, c = records.with_candidates(rows, rows.where("o_custkey % 2 = 0"), known)
    pick = lambda df, side: df.select(F.lit(side).alias("side"), "id", "line", "span")
    return pick(e, "endpoint").unionByName(pick(c, "call"))


@query("borrowed_types", "select o_orderkey as id, case when o_orderkey % 3 = 0 and o_custkey % 2 = 0 and o_orderkey % 5 <> 0 then null else 'T' || (o_custkey % 4) end as symbol from orders")
def borrowed_types(spark, sf_dir):
    r = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "'f' as file", "concat('T', cast(o_custkey % 4 as string)) as symbol", "case when o_orderkey % 3 = 0 then concat('v', cast(o_custkey % 4 as string)) end as payload", "case when o_orderkey % 5 = 0 then concat('call<T', cast(o_custkey % 4 as string), '>(x)') else 'call(x)' end as text")
    bindings = spark.range(4).selectExpr("'f' as file", "concat('v', cast(id as string)) as name", "concat('T', cast(id as string)) as type")
    return records.without_borrowed_types(r, bindings, bindings.where("type in ('T1', 'T3')").select("file", "type")).select("id", "symbol")


SOCKET = ["concat('f', cast(user_id % 8 as string)) as file", "concat('s', cast(event_id % 5 as string)) as root", "case event_id % 3 when 0 then 'on' when 1 then 'emit' else 'close' end as method", "case when event_id % 11 = 0 then 'connect' else event_type end as event"]


@query(
    "socket_directions",
    f"""with x as (select {', '.join(SOCKET)} from events), y as (select *, case when root in ('s0', 's2') then 'client' when root in ('s1', 's3') then 'server' end as kind from x where file <> 'f3' and method <> 'close' and event not in ('connect', 'error'))
select distinct file, event, case when (kind = 'client') = (method = 'on') then 'server_to_client' else 'client_to_server' end as direction, case when method = 'on' then 'listener' else 'emitter' end as side from y where kind is not null""",
)
def socket_directions(spark, sf_dir):
    files = spark.range(8).selectExpr("concat('f', cast(id as string)) as file", "id = 3 as namespaced")
    roots = files.selectExpr("file", "'s0' as name", "'client' as side", "namespaced").unionByName(files.selectExpr("file", "'s1' as name", "'server' as side", "namespaced"))
    bound = files.selectExpr("file", "explode(array(named_struct('name', 's2', 'from_name', 't'), named_struct('name', 't', 'from_name', 's0'), named_struct('name', 's3', 'from_name', 's1'))) as b").select("file", "b.*")
    return records.socket_operations(read(spark, sf_dir, "events").selectExpr(*SOCKET), roots, bound)


@query("stub_files", "select 'a' || (p_partkey % 7) as artifact, 'src/' || p_partkey || '.d.ts' as path, p_name as content from part where p_partkey % 3 <> 0")
def stub_files(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("concat('a', cast(p_partkey % 7 as string)) as artifact", "concat(case when p_partkey % 3 = 0 then 'node_modules/' else 'src/' end, cast(p_partkey as string), '.d.ts') as path", "p_name as content")
    return records.stub_files(records.stub_maps(f))


LIBRARIES = "case n_nationkey % 5 when 0 then 'GraphQL' when 1 then concat('@apollo/', lower(n_name)) when 2 then 'urql' when 3 then 'axios' else concat('graphql-', lower(n_name)) end"


@query("graphql_packages", f"with p as (select {LIBRARIES} as name from nation) select name from p where name in ('GraphQL', 'urql') or name like '@apollo/%'")
def graphql_packages(spark, sf_dir):
    return records.graphql_packages(read(spark, sf_dir, "nation").selectExpr(f"{LIBRARIES} as name"))


@query("raw_targets", with_tables(" select 'http|' || upper(method) || '|' || path as key, file_location as location, arg_max(target_url, call_id) as target from (select *, '/' || split_part(target_url, '/', 3) as path from calls) group by all"))
def raw_targets(spark, sf_dir):
    return records.raw_targets(calls(spark, sf_dir).selectExpr("*", "concat('/', split_part(target_url, '/', 3)) as canonical_path", "call_id as ordinal"))


@query("relative_places", with_tables(" select call_id, case call_id % 3 when 0 then file_location when 1 then file_location else '/other/' || file_location end as file_location from calls"))
def relative_places(spark, sf_dir):
    c = calls(spark, sf_dir).selectExpr("call_id", "concat(case call_id % 3 when 0 then '/work/repo/' when 1 then './' else '/other/' end, file_location) as file_location")
    return records.relative_places(c, ["file_location"], F.lit("/work/repo/"))


HASHED_ALIAS = "concat('Endpoint_', lpad(cast({0} % 20 as string), 16, '0'), '_Response')"


@query(
    "readable_messages",
    f"select o_orderkey as id, 'Type ' || case when o_custkey % 20 < 15 then 'GET /r' || (o_custkey % 20) else {HASHED_ALIAS.format('o_custkey')} end || '[] in ' || case when o_custkey % 20 < 15 then 'call ' || (o_custkey % 20) else {HASHED_ALIAS.format('o_custkey')} || '_Call00000000000000aa' end as text from orders",
)
def readable_messages(spark, sf_dir):
    m = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"concat('Type Array<', {HASHED_ALIAS.format('o_custkey')}, '> in ', {HASHED_ALIAS.format('o_custkey')}, '_Call00000000000000aa') as text")
    names = spark.range(15).selectExpr(f"{HASHED_ALIAS.format('id')} as alias", "concat('GET /r', cast(id as string)) as display").unionByName(spark.range(15).selectExpr(f"concat({HASHED_ALIAS.format('id')}, '_Call00000000000000aa') as alias", "concat('call ', cast(id as string)) as display"))
    return records.readable(m, names)


@query("payload_guard", "select o_orderkey as id, case when o_orderkey % 10 > 0 then repeat('x', (o_orderkey % 10)::int) end as file_results from orders where o_orderkey % 2 = 0 or o_orderkey % 10 = 0 union all select o_orderkey, null from orders where o_orderkey % 2 = 1 and o_orderkey % 10 > 0")
def payload_guard(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 10 > 0 then repeat('x', cast(o_orderkey % 10 as int)) end as file_results", "case when o_orderkey % 2 = 1 then repeat('y', 500) else '' end as body")
    return records.within_limit(rows, 200).select("id", "file_results")


@query("edge_order", http_sql(EDGES_SQL + " select * from edges"))
def edge_order(spark, sf_dir):
    edges = matching.http_edges(match(spark, sf_dir)).drop("agreement")
    return records.ordered_edges(edges.unionByName(edges))


MEMBERS = ["concat('pub', cast(l_suppkey % 3 as string)) as owner_id", "concat('E', cast(l_partkey % 50 as string)) as export", "case when l_linenumber = 7 then 'a.b.c.d.e' else concat('m', cast(l_orderkey as string)) end as chain"]


@query("member_cap", f"with m as (select {', '.join(MEMBERS)} from lineitem) select owner_id, count(*) as n from (select *, row_number() over (partition by owner_id order by export, chain) as r from m where chain <> 'a.b.c.d.e') where r <= 20000 group by owner_id")
def member_cap(spark, sf_dir):
    return records.capped_members(read(spark, sf_dir, "lineitem").selectExpr(*MEMBERS)).groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "result_payload",
    http_sql(
        ALL_FINDINGS
        + f""", sent as (select case kind when 'method_mismatch' then 1 when 'missing_endpoint' then 2 else 4 end as section, case kind when 'missing_endpoint' then json_object('kind', kind, 'severity', severity, 'method', method, 'path', path, 'service', null, 'call_sites', call_sites[1:5])
  when 'method_mismatch' then json_object('kind', kind, 'severity', severity, 'method', method, 'path', path, 'service', null, 'call_sites', call_sites[1:5], 'expected_method', expected_method)
  else json_object('kind', kind, 'severity', severity, 'method', method, 'path', path, 'env_var', env_var, 'call_sites', call_sites[1:5]) end::varchar as payload from findings),
v as (select json_object('method', upper(e.method), 'path', full_path, 'provenance', case when min(prov) = 0 then 'route' else 'mock' end)::varchar as route from endpoints e where evidence <> 'call_site' and (upper(e.method), full_path) in (select (method, full_path) from hit) group by upper(e.method), full_path)
select '{{"repo":"all","stats":{{"endpoints":' || (select count(*) from endpoints) || ',"calls":' || (select count(*) from calls) || '}},"findings":[' || (select string_agg(payload, ',' order by section, payload) from sent) || '],"verified":[' || (select string_agg(route, ',' order by route) from v) || ']}}' as payload"""
    ),
)
def result_payload(spark, sf_dir):
    m = match(spark, sf_dir)
    sent = findings.wire(found(m)).join(spark.createDataFrame([(k, i) for i, k in enumerate(findings.ORDER)], "kind string, section int"), "kind")
    return records.result_payload(sent, matching.verified_endpoints(m), merging.statistics(*http_ops(spark, sf_dir)), "all")


@query("sql_functions", with_tables(f" select distinct full_path, call_path, {o.agreement('full_path', 'call_path')}::int as agreement, {o.specificity('full_path')}::int as literal, {o.catch_all('full_path')} as catch_all from (select full_path, split_part(full_path, '/:', 1) || '/x' as call_path from endpoints)"))
def sql_functions_query(spark, sf_dir):
    sql_functions.register(spark)
    endpoints(spark, sf_dir).selectExpr("full_path", "concat(split_part(full_path, '/:', 1), '/x') as call_path").createOrReplaceTempView("wirelake_pairs")
    return spark.sql("SELECT DISTINCT full_path, call_path, match_agreement(full_path, call_path) AS agreement, path_literal_specificity(full_path) AS literal, is_catch_all_path(full_path) AS catch_all FROM wirelake_pairs")


@query(
    "endpoint_scores",
    """with f as (select distinct p_brand || '/' || (p_size % 9) as key from part where p_partkey % 2 = 0), x as (select distinct p_brand || '/' || (p_size % 9) as key, case when p_partkey % 5 = 0 then 'roadmap' else 'capability' end as tier from part where p_partkey % 3 = 0),
s as (select coalesce(x.tier, 'capability') as tier, (x.tier is not null)::int as h, 1 as f, 0 as e from f left join x using (key) union all select tier, 0, 0, 1 from x),
c as (select tier, sum(h)::bigint as hits, sum(f)::bigint as found, sum(e)::bigint as expected from s group by tier)
select *, hits / found as precision, hits / expected as recall, case when hits = 0 then 0 else 2 * (hits / found) * (hits / expected) / (hits / found + hits / expected) end as f1 from c""",
)
def endpoint_scores(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_brand, '/', cast(p_size % 9 as string)) as key", "case when p_partkey % 5 = 0 then 'roadmap' else 'capability' end as tier")
    return scoring.tiered_scores(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), ["key"])


@query("path_forms", with_tables(f" select ordinal, '/' || array_to_string(list_filter(string_split(full_path, '/'), lambda s: s <> ''), '/') as plain, {o.shape_key('full_path')} = {o.shape_key('replace(full_path, chr(58) || chr(105), chr(58) || chr(106))')} as same_shape from endpoints"))
def path_forms(spark, sf_dir):
    e = endpoints(spark, sf_dir)
    doubled = F.replace(F.col("full_path"), F.lit("/"), F.lit("//"))
    return e.select("ordinal", paths.normalize_path(doubled).alias("plain"), paths.overlap("full_path", F.replace(F.col("full_path"), F.lit(":i"), F.lit(":j"))).alias("same_shape"))


@query("same_files", "select n_nationkey as id, n_nationkey % 4 in (0, 1) as same from nation")
def same_files(spark, sf_dir):
    n = read(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "concat('src/', lower(n_name), '.ts') as a", "case n_nationkey % 4 when 0 then concat('src/', lower(n_name), '.ts') when 1 then concat('repo/src/', lower(n_name), '.ts') when 2 then concat('reposrc/', lower(n_name), '.ts') else 'x.ts' end as b")
    return n.select("id", keys.same_source_file(F.col("a"), F.col("b")).alias("same"))
