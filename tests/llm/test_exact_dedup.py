import hashlib

from wirelake.llm.exact_dedup import compact, exact_dedup, flush_runs


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[fold(t)]
        known = [x for x in ids if x is not None]
        keep = best(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Same"), (2, "same"), (3, "SAME"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "long " * 40_000), (9, "LONG " * 40_000), (10, "x"), (10, "x"), (None, "x"), (None, "alone"), (11, " same")]


def test_against_brute_force(docs_of, clash):
    docs = clash(docs_of(ROWS))
    for keep, best in (("smallest", min), ("largest", max)):
        got = exact_dedup(docs, keep)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS, best)


def test_large_group_and_empty(docs_of):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(3000)]
    got = exact_dedup(docs_of(rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, min)
    assert exact_dedup(docs_of([])).count() == 0


def test_runs_merge(docs_of):
    """Entries over several runs are the entries over their union."""
    a, b = flush_runs(docs_of([(1, "x"), (2, "y")])), flush_runs(docs_of([(0, "X"), (3, "z")]))
    index = {bytes(r["sha"]): (r["keep_id"], r["group_size"]) for r in compact(a.unionByName(b)).collect()}
    assert sorted(index.values()) == [(0, 2), (2, 1), (3, 1)]
