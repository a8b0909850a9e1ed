"""The queries over the driver's tables and their oracle SQL, one entry for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions import bodies, files, keys, paths, urls, versions
from wirelake.operators import dependencies, extraction, findings, graphs, manifests, matching, scoring, sdk, verdicts
from wirelake.plans import oracle as o
from wirelake.sources.derived import CONFIG, calls, endpoints, pages, read, with_tables
from wirelake.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


HTTP = o.routed(CONFIG)


def http_sql(body: str) -> str:
    return with_tables(HTTP + body)


def match(spark: SparkSession, sf_dir: str) -> matching.HttpMatch:
    return matching.HttpMatch(endpoints(spark, sf_dir), calls(spark, sf_dir), CONFIG)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return endpoints(spark, sf_dir), calls(spark, sf_dir)


# URLs and paths

N = o.normal("target_url", CONFIG)


@query("url_normalize", with_tables(f" select call_id, {N['path']} as path, {N['is_internal']} as is_internal, {N['is_external']} as is_external, {N['is_unresolved']} as is_unresolved from calls"))
def url_normalize(spark, sf_dir):
    return calls(spark, sf_dir).withColumn("n", urls.normalize_url("target_url", CONFIG)).select("call_id", "n.path", "n.is_internal", "n.is_external", "n.is_unresolved")


@query(
    "url_host_classify",
    "select page_id, regexp_extract(url, '^https?://([^/]*)', 1) as host, " + o.host_in("regexp_extract(url, '^https?://([^/]*)', 1)", CONFIG.internal_domains) + " as internal, "
    + o.host_in("regexp_extract(url, '^https?://([^/]*)', 1)", CONFIG.external_domains) + " as external from pages",
)
def url_host_classify(spark, sf_dir):
    host = urls.absolute_host("url", CONFIG)
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), urls.host_in(host, CONFIG.internal_domains).alias("internal"), urls.host_in(host, CONFIG.external_domains).alias("external"))


@query("consumer_call_path", with_tables(f" select call_id, {o.call_path('target_url', CONFIG)} as route from calls"))
def consumer_call_path(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", urls.consumer_call_path("target_url", CONFIG).alias("route"))


@query("route_shape_filter", with_tables(f" select distinct upper(method) as method, target_url, file_location from calls where {o.valid_route('target_url')}"))
def route_shape_filter(spark, sf_dir):
    return calls(spark, sf_dir).where(urls.is_valid_route_shape("target_url")).select(F.upper("method").alias("method"), "target_url", "file_location").distinct()


@query("env_var_name", with_tables(f" select call_id, {o.env_name('target_url')} as env_var from calls where {o.env_base('target_url')}"))
def env_var_name(spark, sf_dir):
    return calls(spark, sf_dir).where(urls.is_env_var_base("target_url")).select("call_id", urls.env_var_name("target_url").alias("env_var"))


@query("path_specificity", with_tables(f" select ordinal, {o.specificity('full_path')}::int as specificity, {o.catch_all('full_path')} as catch_all from endpoints"))
def path_specificity(spark, sf_dir):
    return endpoints(spark, sf_dir).select("ordinal", paths.literal_specificity("full_path").alias("specificity"), paths.is_catch_all("full_path").alias("catch_all"))


@query("path_match_agreement", http_sql(" select method, full_path, call_path, agreement::int as agreement from scored where agreement is not null"))
def path_match_agreement(spark, sf_dir):
    e, c = both(spark, sf_dir)
    pairs = matching.candidate_pairs(e, matching.route_calls(c, CONFIG).where("route_status is null"))
    return pairs.withColumn("agreement", paths.match_agreement("full_path", "call_path")).where("agreement is not null")


@query("shape_key_join", with_tables(f" select a.ordinal as a, b.ordinal as b from endpoints a join endpoints b on {o.shape_key('a.full_path')} = {o.shape_key('b.full_path')} and a.owner_id = b.owner_id and a.method < b.method"))
def shape_key_join(spark, sf_dir):
    e = endpoints(spark, sf_dir).withColumn("shape", paths.shape_key("full_path")).select("ordinal", "owner_id", "method", "shape")
    b = e.select(F.col("ordinal").alias("b"), "owner_id", "shape", F.col("method").alias("other"))
    return e.join(b, ["owner_id", "shape"]).where("method < other").select(F.col("ordinal").alias("a"), "b")


# the HTTP analysis


@query("http_match_best", http_sql(" select method, call_path, full_path, agreement::int as agreement from best"))
def http_match_best(spark, sf_dir):
    return match(spark, sf_dir).best


@query("call_route_status", http_sql(" select call_id, route_status from final union all select call_id, status from routed where status is not null"))
def call_route_status(spark, sf_dir):
    return matching.classified_calls(match(spark, sf_dir)).select("call_id", "route_status")


EDGES_SQL = """, edges as (select distinct e.owner_id as producer, 'http|' || b.method || '|' || b.full_path as producer_key, t.owner_id as consumer, 'http|' || t.method || '|' || t.call_path as consumer_key,
  t.file_location as location, case when e.evidence = 'call_site' then 'shared_external_contract' else 'producer_consumer' end as relationship
from todo t join best b using (method, call_path) join endpoints e on upper(e.method) = b.method and e.full_path = b.full_path where b.agreement > 0 and e.owner_id <> t.owner_id)"""


@query(
    "http_edges",
    http_sql(
        """ select distinct e.owner_id as producer, 'http|' || b.method || '|' || b.full_path as producer_key, t.owner_id as consumer, 'http|' || t.method || '|' || t.call_path as consumer_key,
  t.file_location as location, case when e.evidence = 'call_site' then 'shared_external_contract' else 'producer_consumer' end as relationship, b.agreement::int as agreement
from todo t join best b using (method, call_path) join endpoints e on upper(e.method) = b.method and e.full_path = b.full_path where b.agreement > 0 and e.owner_id <> t.owner_id"""
    ),
)
def http_edges(spark, sf_dir):
    return matching.http_edges(match(spark, sf_dir))


SITES = "array_to_string(list_sort(list_distinct(list(file_location))), ',') as call_sites"


@query("missing_endpoints", http_sql(f" select method, call_path as path, {SITES} from final where route_status = 'missing' group by all"))
def missing_endpoints(spark, sf_dir):
    return matching.missing_endpoints(match(spark, sf_dir))


@query("method_mismatch", http_sql(f" select method, path, expected, {SITES} from wrong group by all"))
def method_mismatch(spark, sf_dir):
    return matching.method_mismatches(match(spark, sf_dir))


@query(
    "orphaned_endpoints",
    http_sql(
        f""" select distinct owner_id as service, upper(method) as method, full_path as path from endpoints where evidence <> 'call_site' and not {o.catch_all('full_path')}
and {o.specificity('full_path')} > 0 and (upper(method), full_path) not in (select (method, full_path) from hit) and (upper(method), full_path) not in (select (expected, path) from wrong)"""
    ),
)
def orphaned_endpoints(spark, sf_dir):
    return matching.orphaned_endpoints(match(spark, sf_dir))


@query(
    "verified_endpoints",
    http_sql(" select upper(e.method) as method, full_path as path, case when min(prov) = 0 then 'route' else 'mock' end as provenance from endpoints e where evidence <> 'call_site' and (upper(e.method), full_path) in (select (method, full_path) from hit) group by 1, 2"),
)
def verified_endpoints(spark, sf_dir):
    return matching.verified_endpoints(match(spark, sf_dir))


@query("env_var_calls", http_sql(f" select env_var, method, call_path as path, {SITES} from routed where status = 'env_undeclared' group by all"))
def env_var_calls(spark, sf_dir):
    return matching.env_var_calls(match(spark, sf_dir))


@query(
    "shared_external_contract",
    http_sql(
        """, pairs as (select b.method, b.full_path, e.owner_id as producer, e.file_location as site, t.owner_id as consumer, t.file_location as call_site
  from todo t join best b using (method, call_path) join endpoints e on upper(e.method) = b.method and e.full_path = b.full_path where b.agreement > 0 and e.evidence = 'call_site'),
u as (select method, full_path, producer as repo, site from pairs union all select method, full_path, consumer, call_site from pairs)
select method, full_path as path, array_to_string(list_sort(list_distinct(list(repo))), ',') as repos, count(distinct site) as n_sites from u group by method, full_path having count(distinct repo) >= 2"""
    ),
)
def shared_external_contract(spark, sf_dir):
    return matching.shared_external_contracts(match(spark, sf_dir))


@query(
    "service_dependencies",
    http_sql(" select e.owner_id as service, t.owner_id as consumer, count(distinct (t.method, t.call_path)) as n_routes from todo t join best b using (method, call_path) join endpoints e on upper(e.method) = b.method and e.full_path = b.full_path where b.agreement > 0 and e.owner_id <> t.owner_id group by all"),
)
def service_dependencies(spark, sf_dir):
    return matching.service_dependencies(match(spark, sf_dir))


FOUND = """, found as (
  select 'missing_endpoint' as kind, count(distinct (method, call_path)) as n from final where route_status = 'missing'
  union all select 'method_mismatch', count(distinct (method, path, expected)) from wrong
  union all select 'env_var_call', count(distinct (env_var, method, call_path)) from routed where status = 'env_undeclared')
select kind, case kind when 'method_mismatch' then 'risk' when 'missing_endpoint' then 'gap' else 'advisory' end as severity, n from found where n > 0"""


@query("findings_summary", http_sql(FOUND))
def findings_summary(spark, sf_dir):
    m = match(spark, sf_dir)
    frames = {"method_mismatch": matching.method_mismatches(m), "missing_endpoint": matching.missing_endpoints(m), "env_var_call": matching.env_var_calls(m)}
    return findings.summary(findings.union_findings(frames))


# exact keys, from events: topics are event types with a user's last digit

OPS = [
    "concat('pubsub|', event_type, '-', cast(user_id % 10 as string)) as key",
    "concat('svc', cast(user_id % 7 as string)) as owner_id",
    "case when event_id % 3 = 0 then 'endpoint' else 'call' end as side",
    "case when event_id % 5 = 0 then 1 else 0 end as prov",
    "concat('src/', event_type, '.ts:', cast(event_id % 40 as string)) as file_location",
    "event_id",
]
OPS_SQL = f"with ops as (select {', '.join(OPS)} from events)"


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*OPS)


@query(
    "exact_key_edges",
    OPS_SQL
    + """ select c.key, p.owner_id as producer, c.owner_id as consumer, c.file_location as location, p.prov
from (select distinct key, owner_id, file_location from ops where side = 'call') c join (select key, owner_id, min(prov) as prov from ops where side = 'endpoint' group by all) p on p.key = c.key and p.owner_id <> c.owner_id""",
)
def exact_key_edges(spark, sf_dir):
    return matching.exact_key_edges(ops(spark, sf_dir)).select("key", "producer", "consumer", "location", "prov")


@query("self_loop_keys", "with ops as (select user_id::varchar as key, 'svc' || (user_id % 7) as owner_id, case when event_id % 3 = 0 then 'endpoint' else 'call' end as side from events) select key, min(owner_id) as owner_id from ops group by key having count(distinct owner_id) = 1 and count(distinct side) = 2")
def self_loop_keys(spark, sf_dir):
    return matching.self_loop_keys(read(spark, sf_dir, "events").selectExpr("cast(user_id as string) as key", "concat('svc', cast(user_id % 7 as string)) as owner_id", "case when event_id % 3 = 0 then 'endpoint' else 'call' end as side"))


# dependencies, from parts: a package for each brand, its version from the size

PINS = [
    "concat('svc', cast(p_partkey % 20 as string)) as owner_id",
    "p_brand as package",
    "case p_partkey % 9 when 0 then concat('^', cast(p_size % 4 as string), '.', cast(p_size % 3 as string), '.', cast(p_size as string)) "
    "when 1 then concat(cast(p_size % 4 as string), '.x') when 2 then concat('>=1.0.0 - ', cast(p_size % 4 as string), '.0.0') "
    "else concat('~', cast(p_size % 4 as string), '.', cast(p_partkey % 3 as string), '.', cast(p_size as string)) end as spec",
]
PINS_SQL = f"""with pins as (select {', '.join(PINS)} from part),
clean as (select *, trim(case when len(string_split(s, ' - ')) = 2 then string_split(s, ' - ')[2] else split_part(s, ' || ', 1) end) as version
  from (select *, regexp_replace(spec, '^\\^*~*(>=)*(<=)*>*<*=*', '') as s from pins)),
parsed as (select *, case when regexp_full_match(version, '(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)') then list_transform(string_split(version, '.'), lambda x: x::int) end as v from clean),
merged as (select owner_id, package, version, v from (select *, row_number() over (partition by owner_id, package order by v is not null desc, v desc, version desc) as r from parsed) where r = 1)"""


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*PINS)


@query("package_merge_highest", PINS_SQL + " select owner_id, package, version from merged")
def package_merge_highest(spark, sf_dir):
    return dependencies.merge_highest(pins(spark, sf_dir))


@query(
    "dependency_conflicts",
    PINS_SQL
    + """ select package, array_to_string(list_sort(list_distinct(list(version))), ',') as versions, count(distinct owner_id) as owners,
  case when count(distinct version) filter (v is not null) < 2 then 'info' when count(distinct v[1]) > 1 then 'critical' when count(distinct (v[1], v[2])) filter (v is not null) > 1 then 'warning' else 'info' end as severity,
  case when count(distinct v[1]) > 1 then 'major' else 'unparseable' end as tier
from merged group by package having count(distinct version) > 1 and (count(*) filter (v is null) > 0 or count(distinct v[1]) > 1)""",
)
def dependency_conflicts(spark, sf_dir):
    return dependencies.conflicts(dependencies.merge_highest(pins(spark, sf_dir)))


@query(
    "dedupe_overrides",
    """with r as (select distinct p_brand as name, (p_size % 3) || '.' || (p_partkey % 4) || '.' || p_size as version, p_size % 3 as a, p_partkey % 4 as b, p_size as c from part),
g as (select *, case when a > 0 then a::varchar when b > 0 then '0.' || b else '0.0.' || c end as grp from r),
t as (select *, first_value(version) over w as target, first_value([a, b, c]) over w as top from g window w as (partition by name, grp order by a desc, b desc, c desc))
select name, version, target from t where [a, b, c] < top""",
)
def dedupe_overrides(spark, sf_dir):
    rows = read(spark, sf_dir, "part").selectExpr("p_brand as name", "concat_ws('.', cast(p_size % 3 as string), cast(p_partkey % 4 as string), cast(p_size as string)) as version")
    return dependencies.overrides(rows)


@query("semver_compare", PINS_SQL + " select a.owner_id as owner_id, a.package, a.version, b.version as other from merged a join merged b on a.package = b.package and a.owner_id < b.owner_id where a.v > b.v")
def semver_compare(spark, sf_dir):
    m = dependencies.merge_highest(pins(spark, sf_dir)).withColumn("v", versions.semver("version"))
    other = m.select("package", F.col("owner_id").alias("other_owner"), F.col("version").alias("other"), F.col("v").alias("w"))
    return m.join(other, "package").where("owner_id < other_owner and v > w").select("owner_id", "package", "version", "other")


# verdicts, from line items: outcomes by order and line

OUTCOMES = [
    "l_orderkey as edge", "l_suppkey as producer",
    "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as pair_key",
    "case l_returnflag when 'A' then 'compatible' when 'R' then 'incompatible' else 'unverifiable' end as bucket",
    "case when l_linestatus = 'F' and l_linenumber = 1 then 'baked_any' else 'none' end as gate",
    "concat('line ', cast(l_linenumber as string)) as diagnostic", "l_linenumber as ordinal",
]
CODE = "case when gate = 'baked_any' then 1 when bucket = 'compatible' then 0 when bucket = 'unverifiable' then 1 else 2 end"
NAME = "case {} when 0 then 'compatible' when 1 then 'unverifiable' when 2 then 'incompatible' end"
OUTCOMES_SQL = f"with outcomes as (select {', '.join(OUTCOMES)} from lineitem)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*OUTCOMES)


@query(
    "verdict_overlay",
    OUTCOMES_SQL
    + f""", b as (select edge, max({CODE}) as code, arg_min(diagnostic, pair_key) filter ({CODE} = 2) as first_reason from outcomes group by edge),
j as (select o_orderkey as edge, case when o_orderkey % 17 = 0 then 'shared_external_contract' else 'producer_consumer' end as relationship, code, first_reason from orders left join b on b.edge = o_orderkey),
k as (select edge, relationship, case when relationship = 'producer_consumer' then code end as code, first_reason from j)
select edge, relationship, {NAME.format('code')} as verdict, case code when 0 then true when 2 then false end as compatible, case when code = 2 then first_reason end as reason from k""",
)
def verdict_overlay(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").selectExpr("o_orderkey as edge", "case when o_orderkey % 17 = 0 then 'shared_external_contract' else 'producer_consumer' end as relationship")
    return verdicts.overlay(edges, outcomes(spark, sf_dir), ["edge"])


@query("verdict_rollup", OUTCOMES_SQL + f" select producer, {NAME.format('max(case bucket when $$compatible$$ then 0 when $$unverifiable$$ then 1 else 2 end)')} as verdict from outcomes group by producer")
def verdict_rollup(spark, sf_dir):
    return verdicts.roll_up(outcomes(spark, sf_dir), ["producer"])


@query(
    "compat_pairs",
    OUTCOMES_SQL + " select edge, bool_and(bucket = 'compatible') as compatible, arg_min(diagnostic, ordinal) filter (bucket = 'incompatible') as reason from outcomes where bucket <> 'unverifiable' group by edge",
)
def compat_pairs(spark, sf_dir):
    return verdicts.compat_pairs(outcomes(spark, sf_dir), ["edge"])


@query(
    "diagnostic_buckets",
    """select l_suppkey::varchar as pair_key, case when bool_or(l_tax > 0.0799 and l_discount > 0.0999) or bool_or(l_linenumber = 7 and l_quantity < 3) then 'unverifiable'
  when bool_or(l_linenumber = 6 and l_quantity < 4) then 'incompatible' else 'compatible' end as bucket from lineitem group by l_suppkey""",
)
def diagnostic_buckets(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey as string) as pair_key",
        "case when l_linenumber = 7 and l_quantity < 3 then 1005 when l_linenumber = 6 and l_quantity < 4 then 2322 end as diagnostic_code",
        "l_tax > 0.0799 and l_discount > 0.0999 as probe_failed",
    )
    return verdicts.classify_diagnostics(rows)


# manifests: type pairs, nearest records, SDK spans

TYPED = "select page_id as id, host as owner_id, case when page_id % 2 = 0 then 'GET' else 'POST' end as method, case when page_id % 3 = 0 then 'request' else 'response' end as kind, "
PRODUCER_PATH = "concat('/', label, '/', case page_id % 3 when 0 then ':id' when 1 then '{id}' else seg1 end)"
CONSUMER_PATH = "concat('/', label, '/', case page_id % 2 when 0 then seg1 else upper(seg1) end, case when page_id % 5 = 0 then '/' else '' end)"


def type_path(p: str) -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace('/' || regexp_replace(lower({p}), '/+$', ''), '/+', '/', 'g'), '/'), lambda q: case when regexp_full_match(q, '{o.SHAPE}') or contains(q, '${{') then ':param' else q end), '/')"


COVERED = "not list_contains(list_transform(list_zip(string_split(pp, '/'), string_split(cp, '/')), lambda z: z[1] = z[2] or z[1] = ':param' or z[2] = ':param'), false)"


@query(
    "type_pair_best",
    with_tables(
        f""", a as ({TYPED} {PRODUCER_PATH} as path from p), b as ({TYPED} {CONSUMER_PATH} as path from p),
s as (select c.id as consumer_id, q.id as producer_id, q.path as qpath, c.path as cpath, {type_path('q.path')} as pp, {type_path('c.path')} as cp from a q join b c on q.method = c.method and q.kind = c.kind and q.owner_id <> c.owner_id),
t as (select *, case when qpath = cpath then 100 when pp = cp then 95 when len(string_split(pp, '/')) = len(string_split(cp, '/')) and {COVERED} then 90 end as score from s)
select consumer_id, producer_id, score from (select *, rank() over (partition by consumer_id order by score desc) as r from t where score is not null) where r = 1"""
    ),
)
def type_pair_best(spark, sf_dir):
    p = pages(spark, sf_dir)
    cols = ["page_id as id", "host as owner_id", "case when page_id % 2 = 0 then 'GET' else 'POST' end as method", "case when page_id % 3 = 0 then 'request' else 'response' end as kind"]
    return matching.type_pairs(p.selectExpr(*cols, f"{PRODUCER_PATH} as path"), p.selectExpr(*cols, f"{CONSUMER_PATH} as path"))


@query(
    "nearest_manifest",
    """with ops as (select event_id as id, user_id as key, event_type as role, 'f' || (user_id % 3) as file, (event_id % 500)::int as line from events where event_id % 2 = 0),
rec as (select event_id as record, user_id as key, event_type as role, 'f' || (event_id % 3) as file, (event_id % 500)::int as line, (event_id % 2)::int as tier from events where event_id % 2 = 1)
select id, record from (select o.id, r.record, row_number() over (partition by o.id order by (o.file <> r.file)::int, r.tier, abs(o.line - r.line), r.record) as n from ops o join rec r using (key, role)) where n = 1""",
)
def nearest_manifest(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    o_ = e.where("event_id % 2 = 0").selectExpr("event_id as id", "user_id as key", "event_type as role", "concat('f', cast(user_id % 3 as string)) as file", "cast(event_id % 500 as int) as line")
    r = e.where("event_id % 2 = 1").selectExpr("event_id as record", "user_id as key", "event_type as role", "concat('f', cast(event_id % 3 as string)) as file", "cast(event_id % 500 as int) as line", "cast(event_id % 2 as int) as tier")
    return sdk.nearest_records(o_, r)


CANDIDATES = [
    "o_orderkey as id", "concat('svc', cast(o_custkey % 11 as string)) as consumer", "concat('pkg', cast(o_custkey % 30 as string)) as package",
    "case when o_orderkey % 13 = 0 then null else concat('Api', cast(o_custkey % 3 as string)) end as import_symbol",
    "case when o_orderkey % 19 = 0 then 'deep' end as subpath",
    "case o_orderkey % 7 when 0 then 'client' when 1 then 'client.make().run' else concat('client.m', cast(o_orderkey % 4 as string)) end as callee",
]
PACKAGES = ["concat('pub', cast(s_suppkey % 25 as string)) as owner_id", "concat('pkg', cast(s_suppkey % 50 as string)) as name"]
MEMBERS = ["concat('pub', cast(p_partkey % 25 as string)) as owner_id", "concat('Api', cast(p_partkey % 3 as string)) as export", "concat('m', cast(p_partkey % 4 as string)) as chain", "concat('f', cast(p_size % 2 as string)) as file", "p_size as line", "p_size + 3 as end_line"]
MATCHED = ["concat('pub', cast(l_suppkey % 25 as string)) as owner_id", "concat('f', cast(l_linenumber % 2 as string)) as file", "cast(l_quantity as int) as line", "concat('svc', cast(l_partkey % 5 as string)) as producer"]
SDK_SQL = f"""with c as (select {', '.join(CANDIDATES)} from orders), pk as (select {', '.join(PACKAGES)} from supplier), mem as (select distinct {', '.join(MEMBERS)} from part),
calls as (select distinct {', '.join(MATCHED)} from lineitem),
pub as (select name as package, min(owner_id) as publisher from pk group by name having count(distinct owner_id) = 1),
d as (select c.*, publisher, case when callee like '%(%.%' then null else array_to_string(list_slice(string_split(callee, '.'), 2, 99), '.') end as chain from c left join pub using (package)),
n as (select d.*, mem.file, mem.line, mem.end_line, mem.export is not null as member from d left join mem on mem.owner_id = publisher and mem.export = import_symbol and mem.chain = d.chain),
s as (select distinct n.id, calls.producer from n join calls on calls.owner_id = n.publisher and calls.file = n.file and calls.line between n.line and n.end_line where member),
r as (select id, any_value(consumer) as consumer, any_value(package) as package, any_value(publisher) as publisher, case when any_value(publisher) is null then 'no_sdk_repo_in_project' when any_value(import_symbol) is null then 'receiver_unresolved'
  when any_value(subpath) is not null then 'member_not_found' when any_value(chain) is null then 'receiver_unresolved' when any_value(chain) = '' or not bool_or(member) then 'member_not_found'
  when id not in (select id from s) then 'no_matching_producer' end as reason from n group by id)"""


def sdk_join(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name, cols: read(spark, sf_dir, name).selectExpr(*cols)
    members = read(spark, sf_dir, "part").selectExpr(*MEMBERS).distinct()
    matched = read(spark, sf_dir, "lineitem").selectExpr(*MATCHED).distinct()
    return sdk.resolve(t("orders", CANDIDATES), t("supplier", PACKAGES), members, matched)


@query("sdk_span_join", SDK_SQL + " select id, consumer, package, publisher, producer from r join s using (id) where reason is null")
def sdk_span_join(spark, sf_dir):
    return sdk_join(spark, sf_dir)[0]


@query("sdk_unresolved_reasons", SDK_SQL + " select consumer, package, reason, count(*) as n from r where reason is not null group by all")
def sdk_unresolved_reasons(spark, sf_dir):
    return sdk_join(spark, sf_dir)[1]


# deltas, merges, incremental scans


@query(
    "endpoint_delta",
    """with a as (select distinct o_custkey as service, o_orderpriority as key from orders where o_orderdate >= timestamp '1995-01-01'), b as (select distinct o_custkey as service, o_orderpriority as key from orders where o_orderdate < timestamp '1995-01-01')
select *, 'new' as change from (select * from a except select * from b) union all select *, 'removed' from (select * from b except select * from a)""",
)
def endpoint_delta(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey as service", "o_orderpriority as key", "o_orderdate >= timestamp '1995-01-01' as after")
    return incremental.delta(rows.where("not after"), rows.where("after"), ["service", "key"])


@query("index_merge", with_tables(" select owner_id, method, full_path, ordinal from (select *, row_number() over (partition by owner_id, method, full_path order by ordinal) as r from endpoints) where r = 1"))
def index_merge(spark, sf_dir):
    return findings.first_of(endpoints(spark, sf_dir), ["owner_id", "method", "full_path"], "ordinal").select("owner_id", "method", "full_path", "ordinal")


@query(
    "incremental_merge",
    """with cur as (select o_orderkey as file from orders where o_orderkey % 10 < 8), chg as (select o_orderkey as file from orders where o_orderkey % 7 = 0), cached as (select o_orderkey as file, 'old' as result from orders where o_orderkey % 3 <> 0),
todo as (select file from cur where file in (select file from chg) or file not in (select file from cached))
select file, 'old' as result from cached where file in (select file from cur) and file not in (select file from chg) and file not in (select file from todo) union all select file, 'new' from todo""",
)
def incremental_merge(spark, sf_dir):
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"))
    cur, chg = f.where("file % 10 < 8"), f.where("file % 7 = 0")
    cached = incremental.valid_cache(f.select("file", F.when(F.col("file") % 3 != 0, "old").alias("result"), F.lit(2).alias("cache_version")), 2)
    new = incremental.to_analyse(cur, chg, cached).withColumn("result", F.lit("new"))
    return incremental.merge(cur, chg, cached, new)


# service-local folds


@query(
    "mount_prefix_fanout",
    """with e as (select p_partkey as endpoint_id, p_size as node, '/' || lower(p_brand) as path from part), m as (select n_nationkey as node, '/' || lower(n_name) as prefix from nation union all select n_nationkey, '/' || n_regionkey || '/' from nation)
select distinct endpoint_id, node, path, case when prefix is null then path else regexp_replace(prefix, '/+$', '') || path end as full_path from e left join m using (node)""",
)
def mount_prefix_fanout(spark, sf_dir):
    e = read(spark, sf_dir, "part").selectExpr("p_partkey as endpoint_id", "p_size as node", "concat('/', lower(p_brand)) as path")
    n = read(spark, sf_dir, "nation")
    m = n.selectExpr("n_nationkey as child", "concat('/', lower(n_name)) as path_prefix").unionByName(n.selectExpr("n_nationkey as child", "concat('/', cast(n_regionkey as string), '/') as path_prefix"))
    return graphs.fan_out(e, m)


TWINS = "select page_id as ordinal, 'f:' || (page_id % 20) as file_location, case page_id % 2 when 0 then 'GET' else 'post' end as method, "


@query(
    "twin_semi_join",
    f"""with e as ({TWINS} '/x/:id' as full_path from pages), c as (select 'f:' || (page_id % 23) as file_location, 'GET' as method, '/x/' || page_id as call_path from pages where page_id % 3 = 0)
select ordinal, case when exists (select 1 from c where c.file_location = e.file_location and c.method = upper(e.method)) then 'call_site' else 'route_definition' end as evidence from e""",
)
def twin_semi_join(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    e = p.selectExpr("page_id as ordinal", "concat('f:', cast(page_id % 20 as string)) as file_location", "case page_id % 2 when 0 then 'GET' else 'post' end as method", "'/x/:id' as full_path", "'route_definition' as evidence")
    c = p.where("page_id % 3 = 0").selectExpr("concat('f:', cast(page_id % 23 as string)) as file_location", "'GET' as method", "concat('/x/', cast(page_id as string)) as path")
    return manifests.twins(e, c).select("ordinal", "evidence")


@query(
    "echo_anti_join",
    """with c as (select event_id, event_type as method, (user_id % 50)::varchar as path, event_id % 4 = 0 as anchored from events)
select event_id, method, path, anchored from c where anchored or (method, path) not in (select (method, path) from c where anchored)""",
)
def echo_anti_join(spark, sf_dir):
    return manifests.without_echoes(read(spark, sf_dir, "events").selectExpr("event_id", "event_type as method", "cast(user_id % 50 as string) as path", "event_id % 4 = 0 as anchored"))


@query(
    "self_call_suppression",
    with_tables(f" select call_id from calls c where not exists (select 1 from endpoints e where e.owner_id = c.owner_id and upper(e.method) = upper(c.method) and {o.agreement('e.full_path', 'c.target_url')} > 0)"),
)
def self_call_suppression(spark, sf_dir):
    e, c = both(spark, sf_dir)
    return manifests.without_self_calls(e, c.withColumn("path", F.col("target_url"))).select("call_id")


@query(
    "manifest_rows",
    with_tables(
        """, o as (select *, case when ordinal % 2 = 0 then 'producer' else 'consumer' end as role from endpoints),
b as (select *, unnest(['request', 'response']) as type_kind from o where not (role = 'producer' and evidence = 'call_site')),
k as (select *, 'http|' || method || '|' || full_path as key from b where not (role = 'producer' and type_kind = 'request' and method = 'GET')),
f as (select *, row_number() over (partition by owner_id, key, type_kind, role order by ordinal) as n from k)
select ordinal, role, key, type_kind, case when role = 'producer' and type_kind = 'request' then 'request_body' when role = 'producer' then 'response_body' when type_kind = 'request' then 'call_payload' else 'call_result' end as infer_kind from f where role = 'consumer' or n = 1"""
    ),
)
def manifest_rows(spark, sf_dir):
    e = endpoints(spark, sf_dir).withColumn("role", F.when(F.col("ordinal") % 2 == 0, "producer").otherwise("consumer")).withColumnRenamed("full_path", "path")
    return manifests.manifest_rows(e).select("ordinal", "role", "key", "type_kind", "infer_kind")


@query("anchor_priority", "select alias, ordinal from (select *, row_number() over (partition by alias order by case when o_orderstatus = 'P' then 0 when o_totalprice > 300000 then 1 when o_orderkey % 3 = 0 then 2 else 3 end, ordinal) as n from (select *, o_custkey as alias, o_orderkey as ordinal from orders)) where n = 1")
def anchor_priority(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey as alias", "o_orderkey as ordinal", "case when o_orderstatus = 'P' then 'S' end as symbol", "case when o_totalprice > 300000 then 'L' end as literal", "case when o_orderkey % 3 = 0 then 1 end as line")
    return manifests.anchors(rows).select("alias", "ordinal")


@query("unique_claims", "select o_custkey as key, min(o_orderstatus) as file, min(o_orderpriority) as function from orders group by o_custkey having count(distinct (o_orderstatus, o_orderpriority)) = 1")
def unique_claims(spark, sf_dir):
    return manifests.unique_claims(read(spark, sf_dir, "orders").selectExpr("o_custkey as key", "o_orderstatus as file", "o_orderpriority as function"))


@query("better_attempt", "select l_orderkey as file, max(n) as rows, arg_max(l_linestatus, (n, l_linestatus)) as attempt from (select l_orderkey, l_linestatus, count(*) as n from lineitem group by all) group by l_orderkey")
def better_attempt(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linestatus").alias("attempt")).agg(F.count(F.lit(1)).alias("rows"))
    return manifests.better_attempt(rows)


# graphs, from keys: parent = half

TREE = "with recursive m as (select p_partkey // 2 as parent, p_partkey as child, '/' || (p_partkey % 5) as prefix from part where p_partkey >= 2)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_partkey >= 2").selectExpr("p_partkey div 2 as parent", "p_partkey as child", "concat('/', cast(p_partkey % 5 as string)) as path_prefix")


@query("mount_chain_closure", TREE + ", w as (select parent as node, parent as root, '' as prefix, 0 as depth from m where parent not in (select child from m) union select m.child, w.root, w.prefix || m.prefix, w.depth + 1 from w join m on m.parent = w.node) select node, root, prefix, depth from w where depth > 0")
def mount_chain_closure(spark, sf_dir):
    return graphs.mount_chains(tree(spark, sf_dir)).select("node", "root", "prefix", "depth")


@query("node_types", TREE + " select node, case when node in (select child from m) then 'mountable' else 'root' end as node_type from (select parent as node from m union select child from m)")
def node_types(spark, sf_dir):
    return graphs.node_types(tree(spark, sf_dir))


@query("reachability", TREE + ", w as (select 3::bigint as node, 0 as depth union select m.child, w.depth + 1 from w join m on m.parent = w.node) select node, depth from w")
def reachability(spark, sf_dir):
    edges = tree(spark, sf_dir).selectExpr("parent as src", "child as dst")
    return graphs.reachable(edges, edges.where("src = 3").select(F.col("src").alias("node")).distinct())


@query("topological_levels", TREE + ", w as (select parent as node, child as leaf, 1 as d from m union all select m.parent, w.leaf, w.d + 1 from w join m on m.child = w.node) select node, coalesce(max(d), 0)::int as level from (select parent as node from m union select child from m) left join w using (node) group by node")
def topological_levels(spark, sf_dir):
    t = tree(spark, sf_dir)
    nodes = t.select(F.col("parent").alias("node")).unionByName(t.select(F.col("child").alias("node"))).distinct()
    return graphs.levels(nodes, t.selectExpr("parent as src", "child as dst"))


@query(
    "ownership_lattice",
    TREE + ", f as (select node, ('v' || node % 3) as value from (select unnest([4, 5, 6, 7]) as node)), w as (select node, value from f union select m.child, w.value from w join m on m.parent = w.node) select node as slot, case when count(distinct value) = 1 then min(value) end as value from w group by node",
)
def ownership_lattice(spark, sf_dir):
    facts = tree(spark, sf_dir).where("child between 4 and 7").selectExpr("child as slot", "concat('v', cast(child % 3 as string)) as value")
    return graphs.ownership(facts, tree(spark, sf_dir).selectExpr("parent as src", "child as dst"))


@query(
    "longest_prefix_join",
    """with s as (select distinct regexp_replace(url, '^https?://', '') as specifier from pages), pk as (select distinct split_part(regexp_replace(url, '^https?://', ''), '/', 1) as package from pages
  union select distinct split_part(regexp_replace(url, '^https?://', ''), '/', 1) || '/' || split_part(regexp_replace(url, '^https?://', ''), '/', 2) from pages where page_id % 2 = 0)
select specifier, arg_max(package, length(package)) as package from s join pk on specifier = package or starts_with(specifier, package || '/') group by specifier""",
)
def longest_prefix_join(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("specifier", F.regexp_replace("url", "^https?://", ""))
    packages = p.selectExpr("split_part(specifier, '/', 1) as package").unionByName(p.where("page_id % 2 = 0").selectExpr("concat(split_part(specifier, '/', 1), '/', split_part(specifier, '/', 2)) as package")).distinct()
    return graphs.longest_prefix(p.select("specifier").distinct(), packages)


# evaluation


@query(
    "score_prf",
    """with f as (select lang, doc_id from documents where n_chars > 1500), e as (select lang, doc_id from documents join labels using (doc_id) where quality = 1),
c as (select coalesce(f.lang, e.lang) as lang, count(f.doc_id + e.doc_id) as hits, count(f.doc_id) as found, count(e.doc_id) as expected from f full join e on f.doc_id = e.doc_id group by 1),
s as (select *, case when found = 0 then 1.0 else hits / found end as precision, case when expected = 0 then 1.0 else hits / expected end as recall from c)
select lang, hits, found, expected, precision, recall, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from s""",
)
def score_prf(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return scoring.set_scores(d.where("n_chars > 1500").select("lang", "doc_id"), d.join(good, "doc_id").select("lang", "doc_id"), ["doc_id"], ["lang"])


@query("score_mean_sd", "select o_custkey, round(avg(o_totalprice) + 1e-7, 3) as mean, round(coalesce(stddev_samp(o_totalprice), 0) + 1e-7, 3) as sd from orders group by o_custkey")
def score_mean_sd(spark, sf_dir):
    out = scoring.mean_sd(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return out.select("o_custkey", F.round(F.col("mean") + 1e-7, 3).alias("mean"), F.round(F.col("sd") + 1e-7, 3).alias("sd"))


@query("pass_at_k", "with e as (select l_suppkey, l_partkey, bool_or(l_quantity > 25)::int as a, bool_and(l_quantity > 25)::int as b from lineitem group by all) select l_suppkey, avg(a) as pass_any, avg(b) as pass_all from e group by l_suppkey")
def pass_at_k(spark, sf_dir):
    return scoring.pass_rates(read(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_quantity") > 25), ["l_suppkey"], "l_partkey", "ok")


@query(
    "regression_gate",
    """with now as (select o_orderpriority as p, avg(o_totalprice) as mean from orders where o_orderkey % 2 = 0 group by 1), base as (select o_orderpriority as p, avg(o_totalprice) as mean, coalesce(stddev_samp(o_totalprice), 0) as sd from orders where o_orderkey % 2 = 1 group by 1)
select p, base.mean - now.mean > greatest(sd, 0.05) as regressed from now join base using (p)""",
)
def regression_gate(spark, sf_dir):
    d = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "p")
    return scoring.regressions(scoring.mean_sd(d.where("o_orderkey % 2 = 0"), ["p"], "o_totalprice"), scoring.mean_sd(d.where("o_orderkey % 2 = 1"), ["p"], "o_totalprice"), ["p"]).select("p", "regressed")


@query("label_match", "select n_nationkey as label_id, count(*) filter (contains(url, '/' || lower(left(n_name, 2)) || '/')) as n from nation, pages group by n_nationkey")
def label_match(spark, sf_dir):
    labels = read(spark, sf_dir, "nation").selectExpr("n_nationkey as label_id", "'get' as method", "cast(null as string) as host_contains", "concat('/', lower(left(n_name, 2)), '/') as path_contains")
    return scoring.label_matches(read(spark, sf_dir, "pages").selectExpr("'GET' as method", "url as target"), labels)


@query(
    "claim_one_to_one",
    "with a as (select event_id as op_id, user_id as key, row_number() over (partition by user_id order by event_id) as n from events where event_id % 2 = 0), b as (select event_id as label_id, user_id as key, row_number() over (partition by user_id order by event_id) as n from events where event_id % 2 = 1) select key, op_id, label_id from a join b using (key, n)",
)
def claim_one_to_one(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return scoring.claim(e.where("event_id % 2 = 0").selectExpr("event_id as op_id", "user_id as key"), e.where("event_id % 2 = 1").selectExpr("event_id as label_id", "user_id as key"), ["key"])


# text facts and the query surface


@query("href_calls", "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target, 'GET' as method from pages")
def href_calls(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("target"), F.lit("GET").alias("method"))


def fnv_sql(text: str, prime: int, start: int, bits: int) -> str:
    """FNV-1a over the characters of an ASCII text, in 128-bit numbers."""
    fold = f"list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)::hugeint), lambda h, x: xor(h, x) * {prime}::hugeint % {2**bits}::hugeint, {start}::hugeint)"
    return f"printf('%0{bits // 4}x', {fold}::ubigint)"


HASHED = "concat(method, '|', full_path)"


@query("key_hash32", with_tables(f" select ordinal, {fnv_sql(HASHED, 16777619, 2166136261, 32)} as pair_id, {fnv_sql(HASHED, 1099511628211, 14695981039346656037, 64)} as alias_id from endpoints"))
def key_hash32(spark, sf_dir):
    return endpoints(spark, sf_dir).select("ordinal", keys.fnv32(F.concat_ws("|", "method", "full_path")).alias("pair_id"), keys.fnv64(F.concat_ws("|", "method", "full_path")).alias("alias_id"))


@query("file_locations", with_tables(" select call_id, split_part(file_location, ':', 1) as file, split_part(file_location, ':', 2)::int as line from calls"))
def file_locations(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", keys.file_of("file_location").alias("file"), keys.line_of("file_location").alias("line"))


@query(
    "intent_search",
    """with q as (select unnest(['customer', 'order', 'the', 'that']) as term), d as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) as w from documents)
select doc_id, (select count(*) from q where list_contains(w, term))::int as score from d where score > 0 order by score desc, doc_id limit 20""",
)
def intent_search(spark, sf_dir):
    from wirelake.plans.query_api import search_by_intent

    rows = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("intent"))
    return search_by_intent(rows, "customer order the that", 20, "doc_id")


@query(
    "file_routes",
    with_tables(
        """ select page_id, case when page_id % 3 = 0 then 'nextjs-app' when page_id % 3 = 1 then 'nextjs-pages' else 'astro' end as convention,
  case when page_id % 3 = 0 then '/' || seg1 || '/:id' when page_id % 3 = 1 then '/api/' || seg1 || '/**' else '/' || seg1 end as path from p"""
    ),
)
def file_routes(spark, sf_dir):
    p = pages(spark, sf_dir).selectExpr(
        "page_id", "case page_id % 3 when 0 then concat('src/app/(g)/', seg1, '/[id]/route.ts') when 1 then concat('pages/api/', seg1, '/[...rest].ts') else concat('src/pages/', seg1, '/index.js') end as file"
    )
    return p.withColumn("r", files.route_of("file")).select("page_id", "r.convention", "r.path")


@query("trivial_bodies", "select doc_id, not contains(trim(text), chr(10)) and length(trim(text)) <= 80 as trivial, regexp_matches(text, '(^|[^A-Za-z0-9_$])the($|[^A-Za-z0-9_$])') as mentions_the from documents")
def trivial_bodies(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", bodies.is_trivial("text").alias("trivial"), bodies.mentions("text", F.lit("the")).alias("mentions_the"))


@query("content_hashes", "select doc_id, sha256(length(lang) || ':' || lang || length(text) || ':' || text) as intent_hash from documents")
def content_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", bodies.content_hash("lang", "text").alias("intent_hash"))


@query("call_site_paths", with_tables(" select call_id, regexp_replace(regexp_replace(regexp_replace(case when target_url like '${%}/%' then regexp_replace(target_url, '^[^}]*\\}', '') when regexp_matches(target_url, '^https?://[^/]*/') then regexp_replace(target_url, '^https?://[^/]*', '') else target_url end, '[?#].*$', ''), '\\$\\{(?:[^}]*\\.)?([^.}]+)(?:\\}|$)', ':\\1', 'g'), '\\$\\{[^}]*(?:\\}|$)', '', 'g') as path from calls"))
def call_site_paths(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", bodies.call_site_path("target_url").alias("path"))


@query("dependency_names", "select distinct p_brand as package from part order by 1 limit 500")
def dependency_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("package")).distinct().orderBy("package").limit(500)


@query("egress_cap", "select event_id, user_id from (select *, row_number() over (partition by user_id order by event_type, event_id) as n from events) where n <= 20")
def egress_cap(spark, sf_dir):
    return findings.capped(read(spark, sf_dir, "events"), ["user_id"], ["event_type", "event_id"], 20).select("event_id", "user_id")


@query("socket_fold", "select event_id from events where event_id % 2 = 0 and (user_id, event_type) not in (select (user_id, event_type) from events where event_id % 29 = 1)")
def socket_fold(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", "user_id as file", "event_type as topic", "event_type as event")
    return manifests.fold_sockets(e.where("event_id % 2 = 0").drop("event"), e.where("event_id % 29 = 1")).select("event_id")


@query("transport_fold", with_tables(" select call_id from calls where not (page_file in (0, 1, 2) and (contains(target_url, '${') or regexp_matches(target_url, '^https?://')))").replace("page_file", "(call_id % 7)"))
def transport_fold(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("file", F.col("call_id") % 7)
    gql = c.where("file < 3").select("file", F.lit("call").alias("side"))
    return manifests.fold_transport(c, gql).select("call_id")


UNQUOTED = o.unquoted("target_url")
CALL_ROWS = (
    f", rows as (select call_id, owner_id, upper(method) as method, target_url, {o.call_path('target_url', CONFIG)} as canonical_path, nullif(regexp_extract({UNQUOTED}, '^https?://([^/]*)', 1), '') as host, "
    f"split_part(file_location, ':', 1) as file, split_part(file_location, ':', 2)::int as line from calls where {o.valid_route(UNQUOTED)})"
)


def gated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = calls(spark, sf_dir).withColumns({"file": keys.file_of("file_location"), "line": keys.line_of("file_location")})
    return extraction.call_rows(located, CONFIG)


@query("call_rows", with_tables(CALL_ROWS + " select call_id, method, canonical_path, host from rows"))
def call_rows(spark, sf_dir):
    return gated_calls(spark, sf_dir).select("call_id", "method", "canonical_path", "host")


@query(
    "egress_rows",
    with_tables(
        CALL_ROWS
        + f""" select distinct owner_id, file, line, coalesce(case when {o.host_in('host', CONFIG.external_domains)} then host end, case when starts_with(target_url, 'ENV_VAR:PARTNER_URL:') then 'PARTNER_URL' end) as target,
  case when {o.host_in('host', CONFIG.external_domains)} then 'host' else 'env_var' end as mechanism from rows where {o.host_in('host', CONFIG.external_domains)} or starts_with(target_url, 'ENV_VAR:PARTNER_URL:')"""
    ),
)
def egress_rows(spark, sf_dir):
    none = read(spark, sf_dir, "nation").selectExpr("n_name as owner_id", "n_name as file", "1 as line", "n_name as package").limit(0)
    return extraction.egress_rows(gated_calls(spark, sf_dir), none, CONFIG).select("owner_id", "file", "line", "target", "mechanism")


@query(
    "alias_propagation",
    """with a as (select n_nationkey as file, 'k' || n_regionkey as alias, n_name as env from nation), i as (select n_nationkey + 100 as file, 'k' || n_regionkey as exported, 'l' || n_nationkey as local, n_nationkey as from_file from nation)
select file::varchar as file, alias, env from a union all select i.file::varchar, i.local, a.env from i join a on a.file = i.from_file and a.alias = i.exported""",
)
def alias_propagation(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    a = n.selectExpr("cast(n_nationkey as string) as file", "concat('k', cast(n_regionkey as string)) as alias", "n_name as env")
    i = n.selectExpr("cast(n_nationkey + 100 as string) as file", "'named' as kind", "concat('k', cast(n_regionkey as string)) as exported", "concat('l', cast(n_nationkey as string)) as local", "cast(n_nationkey as string) as from_file")
    return extraction.propagate_aliases(a, i)


@query("type_states", "select o_orderkey as alias, case when o_orderkey % 4 = 0 then (case when o_orderkey % 2 = 1 then 'explicit' else 'unknown' end) when o_orderkey % 4 = 1 then 'explicit' when o_orderkey % 4 = 2 then 'unknown' else 'explicit' end as type_state from orders")
def type_states(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as alias", "o_orderkey % 2 = 1 as is_explicit", "case o_orderkey % 4 when 1 then 'User[]' when 2 then 'any' end as text")
    return extraction.type_states(rows.select("alias", "is_explicit"), rows.where("text is not null").select("alias", "text")).select("alias", "type_state")
