import random

import numpy as np

from wirelake.llm import decontamination as dc

VOCAB = [f"w{i}" for i in range(400)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        p, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[p] = rng.choice(VOCAB)
        elif kind < 0.67:
            words.insert(p, rng.choice(VOCAB))
        else:
            del words[p]
    return words


def distance(item, text):
    """Least edit distance of the item to any part of the text."""
    now = np.zeros(len(text) + 1, int)
    for x in item:
        new = np.empty_like(now)
        new[0] = now[0] + 1
        for j, y in enumerate(text, 1):
            new[j] = min(now[j] + 1, new[j - 1] + 1, now[j - 1] + (x != y))
        now = new
    return now.min()


def case(seed=1):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.choice([1, 2, 5, 9, 20, 45])))) for i in range(20)]
    docs = []
    for d in range(150):
        words = rng.choices(VOCAB, k=rng.randint(0, 60))
        if d % 2:
            item = rng.choice(items)[1].split()
            words += edited(rng, item, rng.randint(0, dc.edits_allowed(len(item)) + 2)) + rng.choices(VOCAB, k=10)
        docs.append((d, " ".join(words)))
    return items, docs


def test_recall_and_precision(spark, docs_of, clash):
    items, rows = case()
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string")
    truth = {(d, i): distance(t.split(), x.split()) for d, x in rows for i, t in items}
    truth = {k: v for k, v in truth.items() if v <= dc.edits_allowed(len(dict(items)[k[1]].split()))}
    extra = [(500, None), (501, ""), (None, items[5][1]), (502, ("filler " * 30_000) + items[4][1].upper() + "!"), (503, items[4][1]), (503, items[4][1])]
    docs = clash(docs_of([*rows, *extra]))
    got = [tuple(r)[:3] for r in dc.find_leaks(docs, benchmark).collect()]
    ours = {(d, i): v for d, i, v in got if d is not None and d < 500}
    assert all(truth.get(k) == v for k, v in ours.items())  # exact distances, no false hits
    assert len(ours) >= 0.99 * len(truth) > 30
    assert {d for d, *_ in got if d is None or d >= 500} == {None, 502, 503}
    kept = {r["doc_id"] for r in dc.without_leaks(docs, benchmark).collect()}
    assert kept == {d for d, _ in [*rows, *extra]} - {d for d, *_ in got}


def test_blocks_and_empty(spark, docs_of, monkeypatch):
    items, rows = case(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in dc.find_leaks(docs_of(rows), benchmark).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 400)
    assert sorted(tuple(r) for r in dc.find_leaks(docs_of(rows), benchmark).collect()) == whole
    assert dc.find_leaks(docs_of([]), benchmark).count() == 0
    assert dc.find_leaks(docs_of(rows), benchmark.limit(0)).count() == 0


def test_recall_of_the_lookup():
    """Items of many lengths at their largest distance, random edits, many items in the table: the share that the sampled bands find."""
    rng = random.Random(3)
    for n in (8, 9, 12, 15, 16, 20, 31, 32, 33, 40, 59, 64, 100, 130):
        words = [rng.choices(VOCAB, k=n) for _ in range(30)]
        items = dc.Items([" ".join(w).encode() for w in words])
        total = hit = 0
        for i, item in enumerate(words * 2):
            text = rng.choices(VOCAB, k=20) + edited(rng, item, dc.edits_allowed(n)) + rng.choices(VOCAB, k=20)
            d = distance(item, text)
            if d <= dc.edits_allowed(n):
                total += 1
                hit += any(x[1] == i % 30 and x[2] == d for x in items.leaks([" ".join(text).encode()]))
        print(n, hit, total)
        assert total > 30 and hit / total >= 0.9, (n, hit, total)


def test_short_items_lose_nothing():
    """Items of under eight words have at most one edit, and are all found."""
    rng = random.Random(4)
    for n in range(1, 8):
        for _ in range(40):
            item = rng.choices(VOCAB, k=n)
            text = rng.choices(VOCAB, k=9) + edited(rng, item, dc.edits_allowed(n)) + rng.choices(VOCAB, k=9)
            if (d := distance(item, text)) <= dc.edits_allowed(n):
                assert [x[2] for x in dc.Items([" ".join(item).encode()]).leaks([" ".join(text).encode()])] == [d]


def test_edits_crowded_at_an_end():
    """All edits in the first or the last words of a long item: another of its windows is untouched."""
    rng = random.Random(6)
    for n in (45, 60, 90, 200):
        item = rng.choices(VOCAB, k=n)
        k = dc.edits_allowed(n)
        for text in ([*rng.choices(["zz", "yy"], k=k), *item[k:]], [*item[:-k], *rng.choices(["zz", "yy"], k=k)]):
            assert dc.Items([" ".join(item).encode()]).leaks([" ".join(["aa"] * 7 + text + ["bb"] * 7).encode()])


def test_memory_of_a_very_long_item():
    """One item of 20,000 words among 2,000 short ones costs what its words cost, not 2,000 times its length."""
    import tracemalloc

    rng = random.Random(7)
    texts = [" ".join(rng.choices(VOCAB, k=n)).encode() for n in [20_000, *[30] * 2000]]
    tracemalloc.start()
    items = dc.Items(texts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 << 20
    assert [x[1] for x in items.leaks([texts[5], b"nothing"])] == [5]


def test_ids_of_any_type(spark, docs_of):
    from decimal import Decimal

    for kind, value in (("double", 1.5), ("decimal(10,2)", Decimal("1.50")), ("date", __import__("datetime").date(2020, 1, 1)), ("binary", bytearray(b"x")), ("array<int>", [1, 2])):
        benchmark = spark.createDataFrame([(value, "one two three four five six seven eight nine")], f"item_id {kind}, text string")
        got = dc.find_leaks(docs_of([(1, "Zero one two three four five six seven, eight nine ten")]), benchmark).collect()
        assert [(r["doc_id"], r["item_id"], r["distance"]) for r in got] == [(1, value, 0)]
