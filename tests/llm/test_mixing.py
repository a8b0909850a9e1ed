import hashlib
import math

from wirelake.llm.mixing import mix_sources


def brute_count(rate, u):
    p, total, k = math.exp(-rate), math.exp(-rate), 0
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_against_brute_force(docs_of):
    rows = [(i, f"t{i}", "en", f"s{i % 3}" if i % 5 else "hot") for i in range(600)]
    weights = {"s0": 3.0, "s1": 1.0, "hot": 4.0}
    got = mix_sources(docs_of(rows), weights, epochs=2.0, seed=3)
    counts = {}
    for r in got.collect():
        counts.setdefault(r["doc_id"], set()).add(r["copy"])
    size = {s: sum(r[3] == s for r in rows) for s in ("s0", "s1", "s2", "hot")}
    for i, _, _, s in rows:
        rate = weights.get(s, 0) / 8 * 1200 / size[s]
        u = int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert counts.get(i, set()) == set(range(brute_count(rate, u) if rate else 0))
    shares = {s: sum(len(counts.get(r[0], ())) for r in rows if r[3] == s) for s in weights}
    assert abs(shares["hot"] - 600) < 100 and abs(shares["s0"] - 450) < 90


def test_large_rate_and_order(docs_of):
    got = mix_sources(docs_of([(1, "a", "en", "s")]), {"s": 1.0}, epochs=2000.0).collect()
    assert 1700 < len(got) < 2300
    keys = [r["shuffle_key"] for r in mix_sources(docs_of([(i, "a") for i in range(50)])).coalesce(1).collect()]
    assert 0 <= min(keys) and max(keys) < 1


def test_edge_cases(docs_of, clash):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "x", "en", "s"), (3, "y", "en", "s"), (3, "y", "en", "s")]
    got = mix_sources(clash(docs_of(rows)), epochs=20.0)
    assert got.columns[-4:] == ["rate", "n_copies", "copy", "shuffle_key"] and got.columns.count("rate") == 1
    found = got.collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, None}
    assert all(r["label"] == "clash" for r in found)
    assert mix_sources(docs_of([])).count() == 0
