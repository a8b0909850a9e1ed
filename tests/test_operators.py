import itertools
import random

from pyspark.sql import functions as F

from wirelake.functions import paths
from wirelake.functions.urls import Config
from wirelake.operators import dependencies, findings, graphs, manifests, matching, scoring, sdk, verdicts
from wirelake.plans import analysis, query_api, report
from wirelake.sources import index
from wirelake.streaming import incremental


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()), key=repr)


def test_candidates_miss_no_match(spark):
    """Every pair that the plain theta join matches is a candidate."""
    random.seed(5)
    seg = ["a", "b", ":x", "{y}", "*", "", "c?", ":z?"]
    make = lambda tail: "/" + "/".join(random.choice(seg) for _ in range(random.randint(0, 4))) + random.choice(tail)
    e = spark.createDataFrame([("GET", make(["", "/*", "/**", "/(.*)", ""])) for _ in range(150)], "method string, full_path string").distinct()
    c = spark.createDataFrame([("GET", make(["", "/q"])) for _ in range(150)], "method string, call_path string").distinct()
    theta = e.join(c, "method").where(paths.paths_match("full_path", "call_path")).select("full_path", "call_path")
    kept = matching.candidate_pairs(e, c).where(paths.paths_match("full_path", "call_path")).select("full_path", "call_path")
    assert rows(theta) == rows(kept) and theta.count() > 100


def test_candidates_of_paths_with_one_first_segment_are_not_all_pairs(spark):
    e = spark.range(200).selectExpr("'GET' as method", "concat('/a/x', id) as full_path").unionByName(spark.createDataFrame([("GET", "/a/:id"), ("GET", "/a/*")], "method string, full_path string"))
    c = spark.range(200).selectExpr("'GET' as method", "concat('/a/x', id) as call_path").unionByName(spark.createDataFrame([("GET", "/a/{k}")], "method string, call_path string"))
    pairs = matching.candidate_pairs(e, c)
    assert pairs.count() == 200 + 2 * 200 + 202  # equal paths, open routes with each path, an open call with each route
    assert pairs.where(~paths.paths_match("full_path", "call_path")).isEmpty()


def two_services(spark):
    e = spark.createDataFrame(
        [
            ("shop", "GET", "/items/:id", "route_definition", 0, "r.ts:1", 1),
            ("shop", "POST", "/items", "route_definition", 0, "r.ts:2", 2),
            ("shop", "GET", "/dead", "route_definition", 0, "r.ts:3", 3),
            ("shop", "GET", "/files/*", "route_definition", 1, "r.ts:4", 4),
            ("web", "GET", "/own", "route_definition", 0, "r.ts:5", 5),
            ("web", "GET", "/pay/status", "call_site", 0, "r.ts:6", 6),
        ],
        "owner_id string, method string, full_path string, evidence string, prov int, file_location string, ordinal long",
    )
    c = spark.createDataFrame(
        [
            (1, "web", "get", "/items/7", "a.ts:1"),
            (2, "web", "DELETE", "/items", "a.ts:2"),
            (3, "web", "GET", "/own", "a.ts:3"),
            (4, "web", "GET", "/nowhere", "a.ts:4"),
            (5, "web", "GET", "${BASE_URL}/x", "a.ts:5"),
            (6, "web", "GET", "https://ext.test/x", "a.ts:6"),
            (7, "shop", "GET", "/pay/status", "b.ts:7"),
            (8, "web", "GET", "/files/a/b", "a.ts:8"),
        ],
        "call_id long, owner_id string, method string, target_url string, file_location string",
    )
    return matching.HttpMatch(e, c, Config(external_domains=("ext.test",)))


def test_classification(spark):
    m = two_services(spark)
    status = dict(rows(matching.classified_calls(m), "call_id", "route_status"))
    assert status == {1: "matched", 2: "wrong_verb", 3: "matched", 4: "missing", 5: "env_undeclared", 6: "external", 7: "matched", 8: "matched"}
    assert rows(matching.http_edges(m), "producer", "consumer", "consumer_key", "relationship") == [
        ("shop", "web", "http|GET|/files/a/b", "producer_consumer"),
        ("shop", "web", "http|GET|/items/7", "producer_consumer"),
        ("web", "shop", "http|GET|/pay/status", "shared_external_contract"),
    ]
    assert ("GET", "/own", "route") in rows(matching.verified_endpoints(m))  # a self call verifies, but gives no edge
    assert rows(matching.orphaned_endpoints(m)) == [("shop", "GET", "/dead")]
    assert rows(matching.method_mismatches(m)) == [("DELETE", "/items", "POST", "a.ts:2")]
    assert rows(matching.missing_endpoints(m)) == [("GET", "/nowhere", "a.ts:4")]
    assert rows(matching.env_var_calls(m), "env_var", "method") == [("BASE_URL", "GET")]
    assert rows(matching.shared_external_contracts(m), "path", "repos", "n_sites") == [("/pay/status", "shop,web", 2)]


def test_exact_keys(spark):
    ops = spark.createDataFrame(
        [("k", "a", "endpoint", 1, "f"), ("k", "a", "endpoint", 0, "g"), ("k", "b", "call", 0, "h"), ("k", "a", "call", 0, "i"), ("lost", "b", "call", 0, "j"), ("loop", "c", "call", 0, "k"), ("loop", "c", "endpoint", 0, "l")],
        "key string, owner_id string, side string, prov int, file_location string",
    )
    assert rows(matching.exact_key_edges(ops), "key", "producer", "consumer", "prov") == [("k", "a", "b", 0)]
    assert rows(matching.self_loop_keys(ops)) == [("loop", "c")]


def test_verdicts_keep_null(spark):
    edges = spark.createDataFrame([(1, "producer_consumer"), (2, "producer_consumer"), (3, "shared_external_contract"), (4, "producer_consumer")], "k int, relationship string")
    outcomes = spark.createDataFrame(
        [(1, "compatible", "none", "p1", "x"), (1, "incompatible", "none", "p3", "late"), (1, "incompatible", "none", "p2", "early"), (3, "incompatible", "none", "p1", "y"), (4, "compatible", "baked_any", "p1", "z")],
        "k int, bucket string, gate string, pair_key string, diagnostic string",
    )
    got = rows(verdicts.overlay(edges, outcomes, ["k"]), "k", "verdict", "compatible", "reason")
    assert got == [(1, "incompatible", False, "early"), (2, None, None, None), (3, None, None, None), (4, "unverifiable", None, None)]


def test_dependencies(spark):
    pins = spark.createDataFrame(
        [("a", "p", "^1.2.0"), ("b", "p", "1.9.9"), ("a", "q", "3.1.0"), ("b", "q", "4.0.0"), ("a", "r", "3.x"), ("b", "r", "4.x"), ("a", "s", "1.0.0"), ("a", "s", "nope"), ("b", "s", "1.0.0")],
        "owner_id string, package string, spec string",
    )
    merged = dependencies.merge_highest(pins)
    assert rows(dependencies.conflicts(merged), "package", "severity", "tier") == [("q", "critical", "major"), ("r", "info", "unparseable")]


def test_sdk_reasons(spark):
    packages = spark.createDataFrame([("pub", "sdk"), ("x", "two"), ("y", "two")], "owner_id string, name string")
    members = spark.createDataFrame([("pub", "Api", "users.get", "c.ts", 10, 20)], "owner_id string, export string, chain string, file string, line int, end_line int")
    calls = spark.createDataFrame([("pub", "c.ts", 15, "backend"), ("pub", "c.ts", 25, "other")], "owner_id string, file string, line int, producer string")
    cand = spark.createDataFrame(
        [
            (1, "web", "sdk", "Api", None, "api.users.get"),
            (2, "web", "two", "Api", None, "api.users.get"),
            (3, "web", "sdk", None, None, "api.users.get"),
            (4, "web", "sdk", "Api", "deep", "api.users.get"),
            (5, "web", "sdk", "Api", None, "api.make().get"),
            (6, "web", "sdk", "Api", None, "api"),
        ],
        "id int, consumer string, package string, import_symbol string, subpath string, callee string",
    )
    edges, lost = sdk.resolve(cand, packages, members, calls)
    assert rows(edges, "id", "producer") == [(1, "backend")]
    assert rows(lost, "package", "reason", "n") == [("sdk", "member_not_found", 2), ("sdk", "receiver_unresolved", 2), ("two", "no_sdk_repo_in_project", 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert rows(graphs.levels(nodes, edges)) == [("a", 2), ("b", 2), ("c", 2), ("x", 1), ("y", 0)]
    assert rows(graphs.reachable(edges, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]
    mounts = spark.createDataFrame([("app", "r1", "/api"), ("r1", "r2", "/v1")], "parent string, child string, path_prefix string")
    assert rows(graphs.mount_chains(mounts), "node", "root", "prefix") == [("r1", "app", "/api"), ("r2", "app", "/api/v1")]
    facts = spark.createDataFrame([("s", "A"), ("t", "B")], "slot string, value string")
    flows = spark.createDataFrame([("s", "u"), ("t", "u"), ("s", "v")], "src string, dst string")
    assert rows(graphs.ownership(facts, flows)) == [("s", "A"), ("t", "B"), ("u", None), ("v", "A")]
    exports = spark.createDataFrame(
        [("i", "f", "forward", "j", "g", 0), ("i", None, "star", "k", None, 1), ("j", "g", "local", None, None, 2), ("k", "h", "local", None, None, 3), ("k", "default", "local", None, None, 4)],
        "file string, name string, kind string, to_file string, to_name string, ordinal long",
    )
    asked = spark.createDataFrame([(1, "i", "f"), (2, "i", "h"), (3, "i", "default")], "id int, file string, name string")
    assert rows(graphs.follow_exports(exports, asked)) == [(1, "j", "g"), (2, "k", "h")]


def test_manifests_and_findings(spark):
    calls = spark.createDataFrame([(1, "GET", "/a", True), (2, "GET", "/a", False), (3, "GET", "/b", False)], "id int, method string, path string, anchored boolean")
    assert rows(manifests.without_echoes(calls), "id") == [(1,), (3,)]
    attempts = spark.createDataFrame([("f", 3, 1), ("f", 3, 2), ("g", 5, 1), ("g", 2, 2)], "file string, rows int, attempt int")
    assert rows(manifests.better_attempt(attempts)) == [("f", 3, 2), ("g", 5, 1)]
    frames = {"missing_endpoint": spark.createDataFrame([("/a",), ("/a",)], "path string"), "dependency_conflict": spark.createDataFrame([("p", "major")], "package string, tier string")}
    found = findings.union_findings(frames)
    assert rows(findings.summary(found)) == [("dependency_conflict", "gap", 1), ("missing_endpoint", "gap", 1)]
    text = report.render(found, has_baseline=False)
    assert text.startswith("<!-- issues: 1 -->") and "## Missing endpoints (1)" in text
    assert report.render(found, has_baseline=True).startswith("<!-- issues: 2 -->")
    only = findings.union_findings({"dependency_conflict": frames["dependency_conflict"]})  # no column named path
    assert "## Dependency conflicts (1)" in report.render(only)


def test_report_sections(spark):
    missing = spark.createDataFrame([("GET", f"/r{i:03}", ["a.ts:1", "b.ts:2"]) for i in range(report.MOST_ROWS + 5)], "method string, path string, call_sites array<string>")
    conflict = spark.createDataFrame([("left|pad", "unparseable")], "package_name string, tier string")
    found = findings.all_findings({"missing_endpoint": missing, "dependency_conflict": conflict})
    delta = spark.createDataFrame(
        [("new", "GET", "/n", "svc", False, None, None), ("removed", "PUT", "/o", None, True, None, None), ("removed", "GET", "/s", None, False, ["pkg"], ["web"])],
        "change string, method string, path string, service string, still_consumed boolean, packages array<string>, consumers array<string>",
    )
    verified = spark.createDataFrame([("GET", "/a", "compatible"), ("GET", "/b", None)], "method string, path string, verdict string")
    sdk = spark.createDataFrame([("pkg", "web"), ("pkg", "app")], "package string, consumer string")
    text = report.render(found, True, delta, verified, sdk, graphql=True)
    for part in (
        f"<!-- issues: {report.MOST_ROWS + 5} -->", f"## Missing endpoints ({report.MOST_ROWS + 5})", "5 more are in the findings table", "left\\|pad", "- New endpoint `GET /n` (`svc`)", "- Removed `PUT /o`, still called",
        "- Removed `GET /s`, still reached through pkg by web", "- compatible: 1", "- not compared: 1", "- `pkg`: app, web", "GraphQL",
    ):
        assert part in text, part
    assert "No issues found" in report.render(found.limit(0))


def test_findings_fields(spark):
    rows_ = spark.createDataFrame([("get", "/x", None, ["a:1"], "A", "B", "d" * 500)], "method string, path string, service string, call_sites array<string>, producer_type string, consumer_type string, detail string")
    found = findings.all_findings({"type_mismatch": rows_, "orphaned_endpoint": rows_.select("method", "path", "service")})
    assert [len(r[0]) for r in found.where("kind = 'type_mismatch'").select("detail").collect()] == [400]
    assert rows(found, "kind", "provenance", "severity") == [("orphaned_endpoint", "route", "gap"), ("type_mismatch", "route", "risk")]
    sent = {r["kind"]: r["payload"] for r in findings.wire(found).collect()}
    assert sent["orphaned_endpoint"] == '{"kind":"orphaned_endpoint","severity":"gap","method":"get","path":"/x","service":null,"provenance":"route"}'
    assert '"producer_provenance":"route"' in sent["type_mismatch"]
    assert [r["kind"] for r in findings.ordered(found).collect()] == ["type_mismatch", "orphaned_endpoint"]


def test_scores(spark):
    found = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "g string, k int")
    expected = spark.createDataFrame([("x", 2), ("x", 3), ("z", 1)], "g string, k int")
    assert rows(scoring.set_scores(found, expected, ["k"], ["g"]), "g", "precision", "recall", "f1") == [("x", 0.5, 0.5, 0.5), ("y", 0.0, 1.0, 0.0), ("z", 0.0, 0.0, 0.0)]
    runs = spark.createDataFrame([("g", 1.0)], "g string, v double")
    assert rows(scoring.mean_sd(runs, ["g"], "v")) == [("g", 1.0, 0.0)]
    leaks = scoring.decoy_leaks(spark.createDataFrame([("GET", "/a"), ("GET", "/b"), ("PUT", "/c")], "method string, path string"), spark.createDataFrame([("*", "/a"), ("POST", "/b"), ("PUT", "/c")], "method string, path string"))
    assert rows(leaks) == [("GET", "/a"), ("PUT", "/c")]


def test_index_round_trip(spark, tmp_path):
    repos = spark.createDataFrame(
        [("org/a", None, "c1", 1, [("GET", "/x")]), ("org/b", "svc", "c2", 1, [("PUT", "/y"), ("GET", "/z")])],
        "repo_name string, service_name string, commit_hash string, cache_version int, endpoints array<struct<method:string,path:string>>",
    )
    index.write_index(repos, str(tmp_path / "store"))
    back = index.read_index(spark, str(tmp_path / "store"))
    assert rows(back, "owner_id") == [("org/a",), ("svc",)]
    assert rows(index.rows_of(back, "endpoints"), "owner_id", "method", "provenance") == [("org/a", "GET", "route"), ("svc", "GET", "route"), ("svc", "PUT", "route")]
    assert index.read_index(spark, str(tmp_path / "store"), isolate=True).isEmpty()
    # a second writer leaves the first one's documents, and replaces its own
    index.write_index(repos.where("repo_name = 'org/b'").withColumn("commit_hash", F.lit("c3")), str(tmp_path / "store"))
    assert rows(index.read_index(spark, str(tmp_path / "store")), "owner_id", "commit_hash") == [("org/a", "c1"), ("svc", "c3")]
    seen = []
    query = incremental.watch(spark, str(tmp_path / "store"), lambda df, epoch: seen.append(df.count()), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert sum(seen) == 2


def test_source_scan(spark, tmp_path):
    for name in ("src/a.ts", "src/a.test.ts", "node_modules/x.js", "tests/b.ts", "README.md", "src/mocks/h.ts", "src/__fixtures__/f.ts", ".storybook/p.js", "src/b.stories.tsx", "spec/s.ts", "e2e/t.ts", "coverage/c.js"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / "src/bad.js").write_bytes(b"x\xff\xfe")
    found = index.scan_sources(spark, str(tmp_path))
    assert rows(found, "path") == [("/coverage/c.js",), ("/e2e/t.ts",), ("/spec/s.ts",), ("/src/a.ts",), ("/src/bad.js",), ("/src/mocks/h.ts",)]
    assert rows(found.where("path like '%mocks%'").select(index.provenance_of(F.col("path")).alias("p"))) == [("mock",)]


def test_delta_and_merge(spark):
    a = spark.createDataFrame([("s", "k1"), ("s", "k2")], "service string, key string")
    b = spark.createDataFrame([("s", "k2"), ("s", "k3")], "service string, key string")
    assert rows(incremental.delta(a, b, ["service", "key"]), "key", "change") == [("k1", "removed"), ("k3", "new")]


def test_analysis(spark, sf):
    from wirelake.plans import queries as q
    from wirelake.sources.derived import CONFIG, calls, endpoints

    edges = q.http_edges(spark, sf).selectExpr(
        "split_part(producer_key, '|', 2) as method", "split_part(producer_key, '|', 3) as identity", "split_part(location, ':', 1) as consumer_file", "cast(split_part(location, ':', 2) as int) as consumer_line"
    )
    outcomes = edges.distinct().withColumns({"bucket": F.lit("incompatible"), "gate": F.lit("none"), "pair_key": F.lit("p"), "diagnostic": F.lit("no")})
    done = analysis.analyse(endpoints(spark, sf), calls(spark, sf), q.ops(spark, sf), q.pins(spark, sf), outcomes, CONFIG)
    kinds = {r["kind"] for r in done.findings.select("kind").distinct().collect()}
    assert {"missing_endpoint", "type_mismatch", "orphaned_endpoint", "dependency_conflict"} <= kinds and done.edges.count() > 0 and done.verified.count() > 0
    assert done.findings.where("kind = 'type_mismatch' and (detail <> 'no' or provenance is null or size(call_sites) = 0)").isEmpty()
    assert done.findings.where("kind = 'dependency_conflict' and size(versions) < 2").isEmpty()
    text = report.render(done.findings)
    assert "## Incompatible types" in text and "## Dependency conflicts" in text


def test_query_surface(spark):
    f = spark.createDataFrame([("a", "loads the user"), ("b", "user user cart"), ("c", None)], "name string, intent string")
    assert [tuple(r) for r in query_api.search_by_intent(f, "user cart", 5).collect()] == [("b", 2), ("a", 1)]
    assert list(itertools.islice(rows(query_api.list_function_intents(f.withColumns({"owner_id": F.lit("s"), "file_path": F.lit("f")}), "s"), "name"), 2)) == [("a",), ("b",)]


def test_long_chain_of_calls(spark):
    """Closures and levels go on past MOST_ROUNDS steps."""
    edges = spark.range(67).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    reached = graphs.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, reached.collect())) == [(i, i) for i in range(68)]
    found = graphs.levels(spark.range(68).select(F.col("id").alias("node")), edges)
    assert sorted(map(tuple, found.collect())) == [(i, 67 - i) for i in range(68)]


def test_ownership_plans_do_not_grow_with_the_rounds(spark):
    nodes = spark.range(2, 1024)
    facts = nodes.where("id between 4 and 7").selectExpr("id as slot", "concat('v', cast(id % 3 as string)) as value")
    out = graphs.ownership(facts, nodes.selectExpr("id div 2 as src", "id as dst"))
    assert len(out._jdf.queryExecution().optimizedPlan().constraints().toString()) < 500  # a union's constraints doubled each round
    assert out.count() == 1020 and out.where("value = 'v0'").count() == 255
