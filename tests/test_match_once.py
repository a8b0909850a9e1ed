from pyspark.sql import functions as F

from wirelake.functions.urls import Config
from wirelake.operators import matching
from wirelake.plans import record_queries

ENDPOINT = "owner_id string, method string, full_path string, evidence string, prov int, file_location string, ordinal long"
CALL = "call_id long, owner_id string, method string, target_url string, file_location string"


def test_env_var_calls_need_no_routes(spark):
    unread = spark.createDataFrame([("shop", "GET", "/a", "route_definition", 0, "r.ts:1", 1)], ENDPOINT).withColumn("full_path", F.raise_error(F.lit("routes were read")).cast("string"))
    calls = spark.createDataFrame([(1, "web", "GET", "${BASE_URL}/x", "a.ts:5"), (2, "web", "GET", "/a", "a.ts:6")], CALL)
    found = matching.env_var_calls(matching.HttpMatch(unread, calls, Config())).collect()
    assert [(r["env_var"], r["method"], r["call_sites"]) for r in found] == [("BASE_URL", "GET", "a.ts:5")]


def test_a_target_url_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def target(i):
        made.add(1)
        return f"/items/{i}"

    calls = spark.range(50).select(F.col("id").alias("call_id"), F.lit("web").alias("owner_id"), F.lit("GET").alias("method"), target("id").alias("target_url"), F.lit("a.ts:1").alias("file_location"))
    endpoints = spark.createDataFrame([("shop", "GET", "/items/:id", "route_definition", 0, "r.ts:1", 1)], ENDPOINT)
    m = matching.HttpMatch(endpoints, calls, Config())
    assert m.best.where("agreement = 1").count() == 50 and m.routed.count() == 50
    assert made.value == 50


def test_the_payload_matches_once(spark, sf, monkeypatch):
    begun, plain = [], matching.HttpMatch.__init__

    def counted(self, *args):
        begun.append(1)
        plain(self, *args)

    monkeypatch.setattr(matching.HttpMatch, "__init__", counted)
    assert record_queries.result_payload(spark, sf).count() == 1
    assert len(begun) == 1
