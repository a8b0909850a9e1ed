"""Schemas of the index as DDL: what extractors deliver for each repository, and defaults for missing fields."""

from __future__ import annotations

ENDPOINTS = (
    "owner_id STRING, method STRING, path STRING, full_path STRING, handler STRING, owner STRING, file_location STRING, "
    "middleware_chain ARRAY<STRING>, repo_name STRING, service_name STRING, provenance STRING, evidence STRING, ordinal BIGINT"
)
CALLS = (
    "owner_id STRING, method STRING, target_url STRING, canonical_path STRING, client STRING, file_location STRING, call_kind STRING, "
    "repo_name STRING, service_name STRING, host STRING, line INT, ordinal BIGINT"
)
MOUNTS = ("owner_id STRING, parent STRING, child STRING, path_prefix STRING, import_source STRING, file STRING, line INT, ordinal BIGINT")
PACKAGES = (
    "owner_id STRING, manifest_path STRING, name STRING, version STRING, dependencies MAP<STRING,STRING>, dev_dependencies MAP<STRING,STRING>, "
    "peer_dependencies MAP<STRING,STRING>, optional_dependencies MAP<STRING,STRING>"
)
CONFIGS = (
    "owner_id STRING, directory STRING, internal_env_vars ARRAY<STRING>, internal_domains ARRAY<STRING>, external_env_vars ARRAY<STRING>, external_domains ARRAY<STRING>"
)
#: One stored document for each (repository, service).
REPO = (
    "repo_name STRING, service_name STRING, commit_hash STRING, last_updated TIMESTAMP, cache_version INT, "
    "endpoints ARRAY<STRUCT<method STRING, path STRING, full_path STRING, handler STRING, owner STRING, file_location STRING, middleware_chain ARRAY<STRING>, provenance STRING, evidence STRING>>, "
    "calls ARRAY<STRUCT<method STRING, target_url STRING, canonical_path STRING, client STRING, file_location STRING, call_kind STRING, host STRING, line INT>>, "
    "mounts ARRAY<STRUCT<parent STRING, child STRING, path_prefix STRING, import_source STRING, file STRING, line INT>>, "
    "packages ARRAY<STRUCT<manifest_path STRING, name STRING, version STRING, dependencies MAP<STRING,STRING>, dev_dependencies MAP<STRING,STRING>, peer_dependencies MAP<STRING,STRING>>>, "
    "config STRUCT<internal_env_vars ARRAY<STRING>, internal_domains ARRAY<STRING>, external_env_vars ARRAY<STRING>, external_domains ARRAY<STRING>>"
)
DEFAULTS = {"provenance": "route", "evidence": "route_definition"}
