"""Index-shaped tables derived from the driver's tables, for queries. The expressions run in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.functions.urls import Config

CONFIG = Config(internal_env=("API_URL",), external_env=("PARTNER_URL",), internal_domains=("example.com", "example.net"), external_domains=("partner.io", "example.org"))

PAGE = [
    "page_id",
    "lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host",
    "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') as path0",
]
PARTS = ["page_id", "host", "path0", "split_part(host, '.', 1) as label", "split_part(path0, '/', 2) as seg1", "split_part(path0, '/', 3) as tail"]
ENDPOINT = [
    "host as owner_id",
    "case page_id % 4 when 1 then 'POST' when 3 then 'PUT' else 'GET' end as method",
    "concat('/', label, '/', seg1, case page_id % 6 when 0 then concat('/', tail) when 1 then '/:id' when 2 then '/{id}' when 3 then '/[id]' when 4 then '/:id?' else '/**' end) as full_path",
    "case when page_id % 11 = 0 then 'call_site' else 'route_definition' end as evidence",
    "case when page_id % 13 = 0 then 1 else 0 end as prov",
    "concat('src/', seg1, '/routes.ts:', cast(page_id % 90 + 1 as string)) as file_location",
    "page_id as ordinal",
]
CALL = [
    "page_id as call_id",
    "caller as owner_id",
    "case page_id % 5 when 1 then 'POST' when 2 then 'get' when 3 then 'DELETE' else 'GET' end as method",
    "case page_id % 7 when 0 then concat('$', '{BASE}/', label, path0) when 1 then concat('ENV_VAR:API_URL:/', label, path0) "
    "when 2 then concat('ENV_VAR:PARTNER_URL:/', label, path0) when 3 then concat('/', label, path0) "
    "when 4 then concat('\"https://', host, '/', label, path0, '?q=1\"') when 5 then concat('https://api.partner.io/', label, path0) "
    "else concat('/', label, '/', seg1, '/$', '{item.id}/') end as target_url",
    "concat('src/', seg1, '.ts:', cast(page_id % 50 + 1 as string)) as file_location",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr(*PAGE).selectExpr(*PARTS)


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr(*ENDPOINT)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    total = p.count()
    callers = p.selectExpr("page_id as caller_id", "host as caller")
    return p.selectExpr("*", f"(page_id * 7 + 3) % {total} as caller_id").join(callers, "caller_id").selectExpr(*CALL)


def with_tables(body: str) -> str:
    """DuckDB: body with the tables p, endpoints and calls in front."""
    return (
        f"with p0 as (select {', '.join(PAGE)} from pages), p as (select {', '.join(PARTS)} from p0), "
        f"endpoints as (select {', '.join(ENDPOINT)} from p), "
        f"calls as (select {', '.join(CALL)} from (select p.*, c.host as caller from p join p c on c.page_id = (p.page_id * 7 + 3) % (select count(*) from p))){body}"
    )
