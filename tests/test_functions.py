import pytest
from pyspark.sql import functions as F

from wirelake.functions import keys, paths, urls, versions
from wirelake.functions.urls import Config

CONFIG = Config(internal_env=("API",), external_env=("EXT",), internal_domains=("https://corp.test:8080/x",), external_domains=("ext.test",))


def values(spark, rows, expression, *names):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ["i", *names])
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


AGREEMENT = [
    (("/pets/:pid", "/pets/9"), 1),
    (("/pets/:pid?", "/pets"), 1),
    (("/pets/{pid}", "/pets/:x"), 1),
    (("/x/**", "/x2/y"), None),
    (("/x/**", "/x/y/z"), 1),
    (("/x/**", "/x"), 1),
    (("/*", "/pets"), 0),
    (("/:v/x/*", "/v1/x/:id"), 1),
    (("/pets/:pid", "/pets/ "), None),
    (("/a/*/c", "/a/b/c"), 2),
    (("/a/b", "/a/b"), 2),
    (("/a/b", "/a/c"), None),
    (("/a/(.*)", "/a/b/c"), 1),
    (("/a/**/**", "/a/q"), 1),
    (("/A", "/a"), None),
    (("/users/me", "/users/:id"), 1),
]


def test_match_agreement(spark):
    got = values(spark, [p for p, _ in AGREEMENT], paths.match_agreement("e", "c"), "e", "c")
    assert got == [x for _, x in AGREEMENT]


def test_shape_and_specificity(spark):
    assert values(spark, ["/a/:x", "/a/{y}?", "/a/<z>"], paths.shape_key("p"), "p") == ["/a/:param"] * 3
    assert values(spark, ["/a/:x", "/", "/a/b?/*"], paths.literal_specificity("p"), "p") == [1, 0, 2]
    assert values(spark, ["/a/<z>", "/a/[z]"], paths.compat_path("p"), "p") == ["/a/<z>", "/a/:param"]


def test_join_paths(spark):
    rows = [("/api", "/users"), ("api/", "users"), ("/api", "/api/users"), ("/api", "/apiary"), ("/", "/x"), ("/api", "/")]
    assert values(spark, rows, paths.join_paths("a", "b"), "a", "b") == ["/api/users", "/api/users", "/api/users", "/api/apiary", "/x", "/api"]


def test_type_pair_score(spark):
    rows = [("/a/b", "/a/b"), ("/A/b/", "/a/b"), ("/a/:id", "/a/7"), ("/a/b", "/a/c")]
    assert values(spark, rows, paths.type_pair_score("p", "c"), "p", "c") == [100, 95, 90, None]


URLS = [
    ("`/a/b?x=1`", "/a/b", False, False),
    ("ENV_VAR:API:/users/${u.id}", "/users/:id", True, False),
    ("ENV_VAR:EXT:/x", "/x", False, True),
    ("https://corp.test/users/${id}?q=1", "/users/:id", True, False),
    ("//api.ext.test:99/x/", "/x", False, True),
    ("process.env.API + '/users/1'", "/users/1", True, False),
    ("${API}/users/${a.b}", "/users/:b", True, False),
    ("/a//", "/a/", False, False),
    ("/a/${}/b/${1x", "/a/:param/b/:param", False, False),
    ("https://corp.test", "/", True, False),
]


def test_normalize_url(spark):
    got = values(spark, [u for u, *_ in URLS], urls.normalize_url("u", CONFIG), "u")
    assert [(g.path, g.is_internal, g.is_external) for g in got] == [tuple(x) for _, *x in URLS]


def test_unresolved_and_injected(spark):
    got = values(spark, ["${u}", "${u}?a=1", "${u}/x", "${API}"], urls.normalize_url("u", CONFIG)["is_unresolved"], "u")
    assert got == [True, True, False, False]
    rows = ["${this.base}/a", "${BASE_URL}/a", "/a/", "https://h.test/a?b", "ENV_VAR:EXT:/a", "word"]
    assert values(spark, rows, urls.consumer_call_path("u", CONFIG), "u") == ["/a", "${BASE_URL}/a", "/a", "/a", "ENV_VAR:EXT:/a", "word"]


def test_route_shape_and_env(spark):
    rows = ["/a", "a", "ENV_VAR:A:/x", "ENV_VAR:A:/A", "ENV_VAR:A:x", "${V}/x", "/a b", "/a||b", "https://h/x", "f(x)", " "]
    assert values(spark, rows, urls.is_valid_route_shape("u"), "u") == [True, False, True, False, False, True, False, False, True, False, False]
    rows = ["ENV_VAR:A:/x", "${process.env.A}/x", "${A_1}", "${host}/x", "${id}", "/u/${id}", "API_URL + '/x'", "Apple"]
    assert values(spark, rows, urls.is_env_var_base("u"), "u") == [True, True, True, True, False, False, True, False]
    rows = ["ENV_VAR:A:/x", "${process.env.B}/x", "${C}/x", "process.env.D + 1", "E_URL/x", "x"]
    assert values(spark, rows, urls.env_var_name("u"), "u") == ["A", "B", "C", "D", "E_URL", "UNKNOWN_API"]


def test_versions(spark):
    rows = ["^1.2.0", "~>=1.0.0", "1.0.0 - 2.0.0", "1.0.0 || 2.0.0", "=3.1.4", "3.x"]
    assert values(spark, rows, versions.clean_spec("s"), "s") == ["1.2.0", "1.0.0", "2.0.0", "1.0.0", "3.1.4", "3.x"]
    assert values(spark, [("1.2.0", "1.10.0"), ("1.0.0-a", "1.0.0"), ("5.3", "1.0.0"), ("01.0.0", "1.0.0")], versions.semver("a") < versions.semver("b"), "a", "b") == [True, True, None, None]
    pairs = [("1.0.0-rc.2", "1.0.0-rc.10"), ("1.0.0-2", "1.0.0-rc"), ("1.0.0-rc", "1.0.0-rc.1"), ("1.0.0-alpha.b", "1.0.0-alpha.beta"), ("1.0.0-9", "1.0.0-10")]
    assert values(spark, pairs, versions.semver("a") < versions.semver("b"), "a", "b") == [True] * 5
    odd = [("1.0.0-01", ""), ("18446744073709551616.0.0", ""), ("18446744073709551615.0.0", ""), ("1.0.0-", ""), ("1.0.0-a..b", ""), ("1.0.0+b.01", ""), ("1.0.0+", "")]
    assert values(spark, odd, versions.semver("a").isNotNull(), "a", "b") == [False, False, True, False, False, True, False]


def test_keys(spark):
    assert values(spark, ["src/a.ts:12:3", "a.ts:0", "C:x", "a.ts"], F.struct(keys.file_of("s"), keys.line_of("s")), "s") == [("src/a.ts", 12), ("a.ts", 1), ("C:x", 1), ("a.ts", 1)]
    assert values(spark, [" get ", "", None], keys.canonical_method("m"), "m") == ["GET", "UNKNOWN", "UNKNOWN"]
    assert values(spark, ["/users/:id?x=1", "/a-b/c"], keys.type_name("r"), "r") == ["UsersById", "ABC"]
    assert values(spark, ["a" * 12, "short"], keys.truncated("t", 8), "t") == ["aaaaa...", "short"]


@pytest.mark.parametrize("bits, name", [(32, "fnv32"), (64, "fnv64")])
def test_fnv(bits, name, spark):
    prime, start = {32: (16777619, 2166136261), 64: (0x100000001B3, 0xCBF29CE484222325)}[bits]

    def brute(s):
        h = start
        for b in s.encode():
            h = (h ^ b) * prime % (1 << bits)
        return f"{h:0{bits // 4}x}"

    rows = ["", "a", "GET|/users/:id", "é中"]
    assert values(spark, rows, getattr(keys, name)("s"), "s") == [brute(s) for s in rows]


def test_top_types_and_topics(spark):
    rows = ["any", "{ any: string }", "Array<unknown>", "'any'", "company", "$any"]
    assert values(spark, rows, keys.normalised_top_type("t"), "t") == [True, False, True, False, False, False]
    df = spark.createDataFrame([("orders.${id}.done", "orders.7.done"), ("a_b", "axb")], ["t", "s"]).withColumn("p", keys.topic_pattern("t"))
    assert [r[0] for r in df.selectExpr("s like p").collect()] == [True, False]
