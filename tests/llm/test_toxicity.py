import random
import zlib

import numpy as np

from wirelake.llm import toxicity as tox

BAD = ["grumble", "snark", "vexing", "blarg", "fiend"]


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "ni", "po") for c in ("n", "s", "t", "l", "m")]
    rows, labels = [], []
    for i in range(n):
        words, y = rng.choices(vocab, k=rng.randint(20, 120)), rng.random() < 0.25
        if y:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ing", ","])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), f"s{i % 4}"))
        labels.append((i, 1, int(y)))
    return rows, labels


def test_held_out_accuracy(spark, docs_of, clash):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "blarg " * 20_000), (9003, "kasen " * 20_000), (None, "fiend"), (9004, "snark"), (9004, "snark")]
    docs = clash(docs_of(rows))
    table = spark.createDataFrame([*labels, (1, 1, 0), (2, None, None), (None, 1, 1), (9004, 1, 7)], "doc_id long, quality int, toxic int")
    model = tox.fit(docs, table)
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, model).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(got[i]["score"] >= 0.5) == bool(y) for i, y in held]
    assert len(held) > 80 and np.mean(right) > 0.97
    assert got[9002]["score"] > 0.5 > got[9003]["score"] and got[9000]["score"] == got[9001]["score"] < 0.5
    kept = {r["doc_id"] for r in tox.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["score"] < 0.5}


def test_score_reads_nothing_but_text(docs_of, spark):
    rows, labels = corpus(300)
    docs = docs_of(rows)
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = rows[3][1]
    got = tox.score_toxicity(docs_of([(1, text, "en", "a"), (2, text, "fr", "b"), (77, text, None, None)]), model).collect()
    assert len({r["score"] for r in got}) == 1


def test_sample_is_bounded_and_folded(docs_of, spark):
    rows, labels = corpus(400)
    got = tox.training_sample(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_class=20).collect()
    assert len(got) == 40 and sum(r["y"] for r in got) == 20
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def test_no_labels_and_no_documents(docs_of, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit(docs_of([(1, "a b")]), empty)
    assert [r["toxic"] for r in tox.score_toxicity(docs_of([(1, "a b"), (2, None)]), model).collect()] == [False, False]
    assert tox.score_toxicity(docs_of([]), model).count() == 0


def test_sample_bounds(spark, docs_of):
    """Repeated ids, conflicting labels and long texts: the sample keeps its bounds, and what it takes is defined."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = docs_of([(i, t) for i in ids for t in (f"text b {i}", f"text a {i}", f"text a {i}")])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in ids] + [(ids[0], 0, 0), (ids[0], 0, 1), (None, 0, 1), (ids[1], 0, 7)], "doc_id long, quality int, toxic int")
    rows = tox.training_sample(docs, labels, 1).collect()
    assert len(rows) == 2 and {r["y"] for r in rows} == {0, 1} and all(r["text"].startswith("text a") for r in rows)
    whole = tox.training_sample(docs, labels, 1000).collect()
    assert len(whole) == len(ids) and {r["y"] for r in whole if r["doc_id"] == ids[0]} == {1}
    assert tox.fit(docs, labels, 20, most_bytes=5).out.any() == False  # noqa: E712  no text fits: an untrained model
