"""DuckDB expressions of the functions, for the oracle queries: plain theta joins and list functions, no candidate keys."""

from __future__ import annotations

PARAM = r"(?s):.*|\{.*\}|<.*>|\[.*\]"
SHAPE = r"(?s):.*|\{.*\}|\[.*\]"


def let(value: str, body: str, name: str = "v") -> str:
    """body with name bound to value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def is_param(s: str) -> str:
    return f"regexp_full_match({s}, '{PARAM}')"


def bare(s: str) -> str:
    return f"rtrim({s}, '?')"


def is_literal(s: str) -> str:
    return f"(not regexp_full_match({s}, '\\s*') and not {is_param(s)} and {s} not in ('*', '**', '(.*)'))"


def specificity(p: str) -> str:
    return f"len(list_filter(list_transform(string_split({p}, '/'), lambda q: {bare('q')}), lambda q: {is_literal('q')}))"


def catch_all(p: str) -> str:
    return f"({p} like '%/*' or {p} like '%/**' or {p} like '%/(.*)')"


def prefix(p: str) -> str:
    return (
        f"(case when {p} like '%/(.*)' then regexp_replace({p}, '(/\\(\\.\\*\\))+$', '') "
        f"else regexp_replace(regexp_replace({p}, '(/\\*\\*)+$', ''), '(/\\*)+$', '') end)"
    )


def total(codes: str) -> str:
    return let(codes, "case when list_contains(k, -1) then null else coalesce(list_sum(k), 0) end", "k")


def params_agreement(e: str, c: str) -> str:
    es, cs = f"string_split({e}, '/')", f"string_split({c}, '/')"
    own = bare("z[1]")
    code = (
        f"case when z[2] is null then (case when z[1] like '%?' then 0 else -1 end) "
        f"when {is_param(own)} or {is_param('z[2]')} then (case when trim({own}) = '' or trim(z[2]) = '' then -1 else 0 end) "
        f"when {own} <> z[2] then -1 when {is_literal(own)} then 1 else 0 end"
    )
    required = f"len(list_filter({es}, lambda q: q not like '%?'))"
    return f"case when len({cs}) between {required} and len({es}) then {total(f'list_transform(list_zip({es}, {cs}), lambda z: {code})')} end"


def wildcard_agreement(e: str, c: str) -> str:
    es, cs = f"string_split({e}, '/')", f"string_split({c}, '/')"
    code = f"case when z[1] = '*' then 0 when z[1] <> z[2] then -1 when {is_literal('z[1]')} then 1 else 0 end"
    return (
        f"case when {catch_all(e)} then (case when {c} = {prefix(e)} or starts_with({c}, {prefix(e)} || '/') then {specificity(prefix(e))} end) "
        f"when len({es}) = len({cs}) then {total(f'list_transform(list_zip({es}, {cs}), lambda z: {code})')} end"
    )


def agreement(e: str, c: str) -> str:
    return f"coalesce(case when {e} = {c} then {specificity(e)} end, {params_agreement(e, c)}, {wildcard_agreement(e, c)})"


def shape_key(p: str) -> str:
    return f"array_to_string(list_transform(list_transform(string_split({p}, '/'), lambda q: {bare('q')}), lambda q: case when {is_param('q')} then ':param' else q end), '/')"


def unquoted(x: str) -> str:
    return f"trim({x}, '`\"''')"


def interpolations(x: str) -> str:
    named = r"\$\{(?:[^}]*[^\p{L}\p{N}_}])?([\p{L}_][\p{L}\p{N}_]*)[^\p{L}\p{N}_}]*(?:\}|$)"
    return f"regexp_replace(regexp_replace({x}, '{named}', ':\\1', 'g'), '\\$\\{{[^}}]*(?:\\}}|$)', ':param', 'g')"


def clean(x: str) -> str:
    lead = "case when starts_with(q, '/') then q else '/' || q end"
    trail = "case when length(q) > 1 and q like '%/' then left(q, length(q) - 1) else q end"
    cut = unquoted(f"split_part(split_part({x}, '?', 1), '#', 1)")
    return f"regexp_replace({let(let(cut, lead, 'q'), trail, 'q')}, '/+', '/', 'g')"


def names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def host_in(h: str, domains: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"lower(split_part({h}, ':', 1)) = '{d}' or lower(split_part({h}, ':', 1)) like '%.{d}'" for d in domains) + ")"


def normal(url: str, config) -> dict[str, str]:
    """path, is_internal, is_external and is_unresolved of the URL forms that the derived calls take."""
    u = unquoted(url)
    env, host = f"split_part({u}, ':', 2)", f"regexp_extract({u}, '^https?://([^/]*)', 1)"
    after = f"regexp_extract({u}, '^https?://[^/]*(/.*)$', 1)"
    variable = f"regexp_extract({u}, '^\\$\\{{([^}}]*)\\}}', 1)"
    rest = f"regexp_replace({u}, '^\\$\\{{[^}}]*\\}}', '')"
    is_env, is_full, is_template = f"starts_with({u}, 'ENV_VAR:')", f"regexp_matches({u}, '^https?://')", f"contains({u}, '${{')"
    leading = f"regexp_matches({u}, '^\\$\\{{[^}}]*\\}}')"
    env_path = f"array_to_string(list_slice(string_split({u}, ':'), 3, 99), ':')"
    path = f"case when {is_env} then {clean(interpolations(env_path))} when {is_full} then {clean(interpolations(f'''coalesce(nullif({after}, ''), '/')'''))} when {is_template} then {clean(interpolations(rest))} else {clean(u)} end"
    inside = lambda env_names, domains: f"(case when {is_env} then {env} in {names(env_names)} when {is_full} then {host_in(host, domains)} when {is_template} then {leading} and {variable} in {names(env_names)} else false end)"
    return {
        "path": path,
        "is_internal": inside(config.internal_env, config.internal_domains),
        "is_external": inside(config.external_env, config.external_domains),
        "is_unresolved": f"({is_template} and not {is_env} and not {is_full} and {leading} and {variable} not in {names(config.internal_env + config.external_env)} and trim(regexp_extract({rest}, '^([^?#]*)', 1), '/') = '')",
    }


def call_path(url: str, config) -> str:
    u, n = unquoted(url), normal(url, config)
    injected = f"(regexp_matches({u}, '^\\$\\{{[^}}]*\\}}/') and not contains({u}, 'process.env.') and not regexp_matches({u}, '^\\$\\{{[A-Z_0-9]+\\}}'))"
    return f"case when {n['is_internal']} or {u} like '/%' or regexp_matches({u}, '^https?://') or (not {n['is_external']} and {injected}) then {n['path']} else {url} end"


def valid_route(r: str) -> str:
    return f"(case when starts_with({r}, 'ENV_VAR:') then regexp_matches({r}, '^ENV_VAR:[A-Za-z0-9_]+:/') and not regexp_matches({r}, '[()\\s]|\\|\\|') else regexp_matches({r}, '^(https?://|/|\\$\\{{)') and not regexp_matches({r}, '[()\\s]|\\|\\|') end)"


def env_base(r: str) -> str:
    return f"(starts_with({r}, 'ENV_VAR:') or contains({r}, 'process.env.') or regexp_matches({r}, '^\\$\\{{[A-Z_0-9]*\\}}') or regexp_matches({r}, '^\\$\\{{[^}}]*\\}}/'))"


def env_name(r: str) -> str:
    return f"case when starts_with({r}, 'ENV_VAR:') then split_part({r}, ':', 2) else regexp_extract({r}, '\\$\\{{(?:[^}}]*\\.)?([^.}}]*)\\}}', 1) end"


def declared(r: str, env: tuple[str, ...], domains: tuple[str, ...]) -> str:
    return f"(case when starts_with({r}, 'ENV_VAR:') then split_part({r}, ':', 2) in {names(env)} else " + " or ".join(f"starts_with({r}, '{d}')" for d in domains) + " end)"


def routed(config) -> str:
    """CTEs routed (calls with status, env_var and call_path), todo and best over the tables of with_tables."""
    target, n = normal("target_url", config), normal("route", config)
    return f""",
r0 as (select call_id, owner_id, upper(method) as method, target_url, file_location, {call_path('target_url', config)} as route, {target['is_external']} as raw_external
  from calls where {valid_route('target_url')} or {valid_route(unquoted('target_url'))}),
routed as (select *, {n['path']} as call_path, case when {declared('route', config.external_env, config.external_domains)} or raw_external then 'external'
    when {n['is_unresolved']} then 'unresolved' when {env_base('route')} and not {n['is_internal']} then 'env_undeclared' end as status,
    case when {env_base('route')} then {env_name('route')} end as env_var from r0),
todo as (select * from routed where status is null),
scored as (select *, {agreement('full_path', 'call_path')} as agreement
  from (select distinct e.method, full_path, call_path from (select distinct upper(method) as method, full_path from endpoints) e join (select distinct method, call_path from todo) c on e.method = c.method)),
best as (select * from (select *, rank() over (partition by method, call_path order by agreement desc) as r from scored where agreement is not null) where r = 1),
hit as (select distinct method, full_path from best where agreement > 0),
final as (select t.*, agreement, case when agreement > 0 then 'matched' when agreement = 0 then 'routed_only'
    when {shape_key('t.call_path')} in (select {shape_key('full_path')} from endpoints) then 'wrong_verb' else 'missing' end as route_status
  from todo t left join (select method, call_path, max(agreement) as agreement from best group by all) b using (method, call_path)),
marked as (select distinct upper(method) as expected, full_path, {shape_key('full_path')} as shape, (upper(method), full_path) in (select (method, full_path) from hit) as verified from endpoints),
wrong as (select f.method, m.full_path as path, m.expected, f.file_location from final f
  join (select shape, unnest([min({{'v': verified::int, 'expected': expected, 'full_path': full_path}})], recursive := true) from marked group by shape) m on m.shape = {shape_key('f.call_path')}
  where route_status = 'wrong_verb')
"""
