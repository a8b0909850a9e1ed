import random

import numpy as np
import pytest

from wirelake.llm import jaccard_join as jj
from wirelake.llm.components import components


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    name = lambda i: rows[i][0] if not sets[i] else min((x for x in least[find(i)] if x is not None), default=None)
    return sorted(((d, len(sets[i]), name(i), sets.count(sets[i]) if sets[i] else 1) for i, (d, _) in enumerate(rows)), key=repr)


def noisy(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocab, k=40)
    bases = [rng.choices(vocab, k=rng.choice([8, 30, 60, 200])) for _ in range(12)]
    rows = []
    for i in range(n):
        words = noisy(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3, 5])) if rng.random() < 0.7 else rng.choices(vocab, k=rng.randint(0, 60)) + passage
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_against_brute_force(docs_of, clash, k, percent, seed):
    rows = corpus(seed)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (1004, "One Two"), (None, "one two"), (None, "lonely words here now"), (1005, "big " + "x y z " * 9000)]
    got = sorted((tuple(r) for r in jj.jaccard_components(clash(docs_of(rows)), k, percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_hot_buckets_take_further_pivots(docs_of, monkeypatch):
    """A chain of near copies that no single pivot connects, with hot buckets from two rows on."""
    monkeypatch.setattr(jj, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(jj, "PAIRS_FOR_PIVOTS", 0)
    rng = random.Random(4)
    words = [f"a{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = sorted((tuple(r) for r in jj.jaccard_components(docs_of(rows), 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_empty(docs_of):
    assert jj.jaccard_components(docs_of([])).count() == 0
    assert jj.jaccard_components(docs_of([(1, None)])).collect()[0]["component_id"] == 1


def test_signatures_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(2))
        h = jj.least_difference(*(np.frombuffer(jj.parities(s), np.uint8) for s in (x, y)))
        assert h <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, x) for x in range(4000, 4100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
