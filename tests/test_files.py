from pyspark.sql import functions as F

from wirelake.functions import bodies, files
from wirelake.sources import graphql


def values(spark, rows, expression, *names):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ["i", *names])
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_file_routes(spark):
    cases = {
        "src/app/users/[id]/route.ts": ("nextjs-app", "/users/:id"),
        "app/(shop)/cart/[...rest]/route.js": ("nextjs-app", "/cart/**"),
        "app/route.ts": ("nextjs-app", "/"),
        "app/users/page.tsx": None,
        "pages/api/users/index.ts": ("nextjs-pages", "/api/users"),
        "./src/pages/api/[user.id].ts": ("nextjs-pages", "/api/:userid"),
        "pages/api/_helper.ts": None,
        "src/pages/feed.js": ("astro", "/feed"),
        "app/routes/users.$id.edit.ts": ("remix-flat", "/users/:id/edit"),
        "app/routes/_auth.login.ts": None,
        "app/routes/users._layout.edit.ts": ("remix-flat", "/users/edit"),
        "app/routes/files.$.ts": ("remix-flat", "/files/**"),
        "lib/users.ts": None,
    }
    got = values(spark, list(cases), files.route_of("p"), "p")
    assert [tuple(g) if g else None for g in got] == list(cases.values())
    assert values(spark, ["GET", "loader", "x"], files.method_of_export("e", files.FLAT), "e") == ["GET", "GET", None]
    assert values(spark, ["/a/ b /[c.d]", "//", "/[...x]"], files.canonical_route("p"), "p") == ["/a/b/:cd", "/", "/**"]


def test_fallbacks(spark):
    cases = {
        "${A ?? 'x}'}/p": "${A}/p",
        "${process.env.B || `y`}/${id}": "${process.env.B}/${id}",
        "${f(a || b)}/x": "${f(a || b)}/x",
        "${A ?? }": "${A ?? }",
        "${a.b ?? {c: 1}}z": "${a.b}z",
        "${open ?? x": "${open ?? x",
        "plain || text": "plain || text",
    }
    assert [bodies.without_fallback(t) for t in cases] == list(cases.values())
    assert values(spark, list(cases), bodies.env_fallback_target("t"), "t") == list(cases.values())


def test_bodies(spark):
    assert values(spark, ["return 1", "a\nb", "x" * 81], bodies.is_trivial("b"), "b") == [True, False, False]
    assert values(spark, [("call foo()", "foo"), ("foobar()", "foo"), ("$foo", "foo"), ("a.foo", "foo"), ("x", "")], bodies.mentions("b", "n"), "b", "n") == [True, False, False, True, False]
    local = bodies.is_local_callee(F.col("c"), F.col("b"), F.col("k"))
    assert values(spark, [("A.f", "this.g()", "A.g"), ("f", "B.g()", "B.g"), ("f", "g()", "B.g"), ("f", "f()", "f")], local, "c", "b", "k") == [True, True, False, False]
    assert values(spark, ["${base}/a/${x.id}?q", "https://h.test/a#b", "/a/${}/c", "https://h"], bodies.call_site_path("u"), "u") == ["/a/:id", "/a", "/a//c", "https://h"]
    assert values(spark, ["[[Item!]!]!", "Item"], bodies.list_depth("t"), "t") == [2, 0]
    df = spark.createDataFrame([("`${api}/x`",), ("${other}/x",)], ["t"]).withColumn("m", F.create_map(F.lit("api"), F.lit("API_URL")))
    assert [r[0] for r in df.select(bodies.with_env_alias("t", "m")).collect()] == ["`${process.env.API_URL}/x`", "${other}/x"]
    hashes = values(spark, [("ab", "c"), ("a", "bc"), ("ab", None)], bodies.content_hash("x", "y"), "x", "y")
    assert len(set(hashes)) == 3


def test_graphql(spark):
    schema = 'schema { query: Root }\n"""doc"""\ntype Root { users(first: Int = 3): [User!]! me: User @auth }\ntype Mutation { add(x: [Int]): Int }\ntype User { id: ID }'
    document = "query Q($a: Int) { people: users(first: $a) { id } ...F me { id } __typename }\nfragment F on Root { me { id } }\nmutation { add(x: [1]) }\n{ me }"
    rows = spark.createDataFrame([("s.graphql", schema), ("d.graphql", document), ("n", None)], "path string, content string")
    got = sorted(tuple(r) for r in graphql.operations(rows).fillna("").collect())
    assert got == [
        ("d.graphql", "call", "mutation", "add", ""), ("d.graphql", "call", "query", "me", ""), ("d.graphql", "call", "query", "me", ""), ("d.graphql", "call", "query", "users", ""),
        ("s.graphql", "endpoint", "mutation", "add", "Int"), ("s.graphql", "endpoint", "query", "me", "User"), ("s.graphql", "endpoint", "query", "users", "[User!]!"),
    ]
