from wirelake.functions.urls import Config
from wirelake.operators import extraction as ex

CONFIG = Config(external_env=("EXT",), external_domains=("ext.test",))


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()), key=repr)


def test_rows_and_egress(spark):
    facts = spark.createDataFrame([("get", "src/a.ts", 0), ("UNKNOWN", "src/a.ts", 3), ("PUT", "tests/b.ts", 4)], "method string, file string, line int")
    assert rows(ex.endpoint_rows(facts), "method", "provenance", "file_location") == [("GET", "route", "src/a.ts:1"), ("PUT", "mock", "tests/b.ts:4")]
    calls = spark.createDataFrame(
        [("s", "", "https://api.ext.test/v1/x", "a.ts", 1), ("s", "QUERY", "/x", "a.ts", 2), ("s", "GET", "/:id", "a.ts", 3), ("s", "GET", "ENV_VAR:EXT:/y", "a.ts", 4), ("s", "GET", "/ok", "a.ts", 0), ("s", "POST", "/ok", "a.ts", 6)],
        "owner_id string, method string, target_url string, file string, line int",
    )
    got = ex.call_rows(calls, CONFIG)
    assert rows(got, "line", "method", "canonical_path", "host") == [(1, "GET", "/v1/x", "api.ext.test"), (4, "GET", "ENV_VAR:EXT:/y", None), (6, "POST", "/ok", None)]
    sdk = spark.createDataFrame([("s", "b.ts", 9, "stripe")], "owner_id string, file string, line int, package string")
    assert rows(ex.egress_rows(got, sdk, CONFIG), "line", "target", "mechanism") == [(1, "api.ext.test", "host"), (4, "EXT", "env_var"), (9, "stripe", "sdk")]
    assert ex.egress_rows(got, sdk, CONFIG, most=2).count() == 2


def test_signals_and_sanitation(spark):
    facts = spark.createDataFrame([("fetch", None, "'/x'", True), ("apiClient.get", None, "id", False), ("bus.publish", None, "'t'", False), ("sum", None, "1", False), ("axios.get", "axios", "u", False)], "callee string, package string, first_argument string, awaited boolean")
    assert rows(ex.candidate_signals(facts), "callee", "candidate") == [("apiClient.get", True), ("axios.get", True), ("bus.publish", True), ("fetch", True), ("sum", False)]
    raw = spark.createDataFrame([("((a))", "node:fs", "t"), ("null", "./x", "t"), ("(a)(b)", "y", " "), ("f(x)", None, "t")], "symbol string, import_source string, topic string")
    assert rows(ex.clean_results(raw, ["symbol"]), "symbol", "import_source") == [("a", None), ("f(x)", None), (None, "./x")]


def test_aliases(spark):
    aliases = spark.createDataFrame([("env.ts", "api", "API_URL"), ("env.ts", "api.v2", "API2"), ("env.ts", "default", "DEF"), ("b.ts", "base", "OWN")], "file string, alias string, env string")
    imports = spark.createDataFrame([("a.ts", "named", "api", "x", "env.ts"), ("a.ts", "default", None, "d", "env.ts"), ("c.ts", "namespace", None, "ns", "env.ts"), ("b.ts", "named", "api", "base", "env.ts")], "file string, kind string, exported string, local string, from_file string")
    got = {(f, a): e for f, a, e in rows(ex.propagate_aliases(aliases, imports))}
    assert got[("a.ts", "x")] == "API_URL" and got[("a.ts", "x.v2")] == "API2" and got[("a.ts", "d")] == "DEF"
    assert got[("c.ts", "ns.api")] == "API_URL" and got[("b.ts", "base")] == "OWN" and got[("b.ts", "base.v2")] == "API2"


def test_diagnostics_and_poison(spark):
    text = ["Found 2 errors", "a.ts(3,5): error TS2322: Type 'x'", "  is not 'y'.", "b.ts(7,1): error TS2307: No module", "done"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "run int, number int, text string")
    assert rows(ex.parse_diagnostics(lines)) == [(1, "a.ts", 3, 2322, "Type 'x'\nis not 'y'."), (1, "b.ts", 7, 2307, "No module")]
    entries = spark.createDataFrame([("A", "a.ts"), ("B", "b.ts"), ("C", "c.ts")], "alias string, file string")
    imports = spark.createDataFrame([("a.ts", "m.ts"), ("m.ts", "b.ts"), ("c.ts", "d.ts")], "file string, to_file string")
    assert rows(ex.poisoned_aliases(entries, imports, spark.createDataFrame([("b.ts",)], "file string"))) == [("A",), ("B",)]
    spans = spark.createDataFrame([("A", "a.ts", 1, 4), ("B", "a.ts", 5, 9)], "alias string, file string, first int, last int")
    assert rows(ex.aliases_at(spans, ex.parse_diagnostics(lines))) == [("A", 2322)]
    states = ex.type_states(spark.createDataFrame([("A", True), ("B", False), ("C", False), ("D", True)], "alias string, is_explicit boolean"), spark.createDataFrame([("A", "X"), ("B", "Y[]"), ("D", "any")], "alias string, text string"))
    assert rows(states, "alias", "type_state") == [("A", "explicit"), ("B", "implicit"), ("C", "unknown"), ("D", "unknown")]
    anchors = spark.createDataFrame([("A", "S", None), ("B", "S", 2)], "alias string, symbol string, depth int")
    assert rows(ex.inherit_depth(anchors, spark.createDataFrame([("A", "S", 1)], "alias string, symbol string, depth int")), "alias", "depth") == [("A", 1), ("B", 2)]
