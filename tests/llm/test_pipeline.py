import pytest

import corpus_pipeline as cp
from wirelake.llm import decontamination, toxicity


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if all(sets) else 0.0


def test_stages_against_brute_force(spark, sf):
    """Each stage's decisions over the smallest tables, from a plain version of its rule on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_copies", "decontamination", "mixing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    now = steps["toxicity"](spark, docs, sf).cache()
    assert now.columns == docs.columns
    rows = {i: t for i, t in rows.items() if scores[i] < 0.5}
    assert {r["doc_id"] for r in now.collect()} == set(rows)

    first = {}
    for i in sorted(rows):
        first.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in rows[i] or ""), i)
    rows = {i: rows[i] for i in first.values()}
    now = steps["exact_dedup"](spark, now, sf).cache()
    assert {r["doc_id"] for r in now.collect()} == set(rows)

    ids, root = sorted(rows), {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and jaccard(rows[a], rows[b]) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    rows = {i: t for i, t in rows.items() if root[i] == i}
    now = steps["near_copies"](spark, now, sf).cache()
    assert {r["doc_id"] for r in now.collect()} == set(rows)

    items = [" ".join(w.decode() for w in decontamination.plain_words((r["text"] or "").encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {i: " ".join(w.decode() for w in decontamination.plain_words((t or "").encode())) for i, t in rows.items()}
    leaking = {i for i, t in plain.items() if any(x and f" {x} " in f" {t} " for x in items)}
    now = steps["decontamination"](spark, now, sf).cache()
    left = {r["doc_id"] for r in now.collect()}
    assert not left & leaking and len(left) >= len(rows) - len(leaking) - 2
    mixed = steps["mixing"](spark, now, sf)
    assert {r["doc_id"] for r in mixed.collect()} <= left and abs(mixed.count() - len(left)) < 6 * len(left) ** 0.5


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 50


@pytest.fixture
def small(spark, tmp_path):
    """A folder with a benchmark and labels beside documents."""
    words = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), words


def long_text(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows(spark, docs_of, clash, small, name):
    """Repeated and null ids, null, empty and long texts, repeated rows, clashing columns: what each stage keeps, by its rule."""
    folder, item = small
    near = long_text(100)
    rows = [
        (10, "x y"), (10, "x y"), (1, "Y"), (2, "y"), (2, "unique text"), (None, "y"), (None, "lonely"), (None, "lonely"), (5, None), (6, ""), (7, ""),
        (20, near), (21, near + " more"), (21, "quite another thing under the same number"), (None, near + " less"), (30, f"before {item} after"), (31, long_text(60_000, 1000)),
    ]
    docs = clash(docs_of(rows))
    out = dict(cp.STAGES)[name](spark, docs, folder)
    got = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None and r["text"] is not None), sum(r["text"] is None for r in out.collect()), sorted(r["text"] for r in out.collect() if r["doc_id"] is None)
    everything = sorted((i, t) for i, t in rows if i is not None and t is not None)
    if name != "mixing":
        assert out.columns == docs.columns
    if name == "toxicity":  # no labels: nothing is toxic
        assert got == (everything, 1, sorted(t for i, t in rows if i is None))
    elif name == "exact_dedup":
        gone = [(10, "x y"), (2, "y"), (6, ""), (7, "")]
        left = list(everything)
        for g in gone:
            left.remove(g)
        assert got[0] == left and got[1] == 1 and got[2] == sorted(["lonely", near + " less"])
    elif name == "near_copies":
        left = list(everything)
        for g in [(10, "x y"), (2, "y"), (21, near + " more")]:
            left.remove(g)
        assert got == (left, 1, ["lonely"])
    elif name == "decontamination":
        left = [x for x in everything if x[0] != 30]
        assert got == (left, 1, sorted(t for i, t in rows if i is None))
    else:
        assert set(got[0]) <= set(everything) and out.count() > 0
    assert dict(cp.STAGES)[name](spark, docs.limit(0), folder).count() == 0
