import random

import numpy as np

from wirelake.llm import substring_dedup as sd


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(vocab, k=rng.choice([30, 55, 80, 200])) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        if i % 2:
            words += rng.choice(passages) + rng.choices(vocab, k=rng.randint(0, 50))
        rows.append((i, " ".join(words)))
    return rows, passages


def exact_windows(rows, size):
    """(id, start) of every run of size words that a document with a smaller id has."""
    first, out = {}, set()
    for i, t in sorted(rows):
        words = t.lower().split()
        grams = [tuple(words[p : p + size]) for p in range(len(words) - size + 1)]
        out |= {(i, p) for p, g in enumerate(grams) if first.get(g, i) != i}
        for g in grams:
            first.setdefault(g, i)
    return out


def test_exact_passages(docs_of, clash):
    rows, _ = corpus()
    got = sd.repeated_passages(clash(docs_of(rows))).collect()
    spans = [(r["doc_id"], r["start_word"], r["end_word"]) for r in got]
    truth = exact_windows(rows, 50)
    assert len(truth) > 100
    assert all(any(d == i and a <= p and p + 50 <= b for d, a, b in spans) for i, p in truth)
    assert {d for d, _, _ in spans} == {i for i, _ in truth}  # nothing else


def test_fuzzy_passages(docs_of):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(160)]
    variant = list(passage)
    for p in rng.sample(range(10, 150), 5):
        variant[p] = f"edit{p}"
    del variant[70]
    variant.insert(40, "more")
    rows = [(1, " ".join(["a"] + passage + ["b", "c"])), (2, " ".join([f"x{i}" for i in range(30)] + variant + [f"y{i}" for i in range(30)]))]
    (found,) = sd.repeated_passages(docs_of(rows)).collect()
    assert (found["doc_id"], found["first_id"]) == (2, 1)
    assert abs(found["start_word"] - 30) <= 1 and abs(found["end_word"] - 190) <= 1 and 5 <= found["edits"] <= 9


def test_chaining_is_best():
    """The Fenwick tree finds the score of the plain quadratic recurrence."""
    rng = random.Random(6)
    for _ in range(100):
        links = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))})
        score = [0.0] * len(links)
        for j, (p, q) in enumerate(links):
            score[j] = sd.LINK + max([0.0, *(score[i] - sd.GAP * ((p - a) + (q - b)) / 2 for i, (a, b) in enumerate(links[:j]) if a < p and b < q)])
        best = sd.chains(links)[0]
        cost = sum(((c[0] - a[0]) + (c[1] - a[1])) / 2 for a, c in zip(best, best[1:], strict=False))
        assert abs(len(best) * sd.LINK - sd.GAP * cost - max(score)) < 1e-9


def test_edge_cases(docs_of):
    same = " ".join(f"s{i}" for i in range(70))
    rows = [(1, None), (2, ""), (3, "few words"), (None, same), (4, same), (5, same.upper()), (6, same + " " + same), (7, "z " * 30_000), (8, same), (8, same)]
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["first_id"]) for r in sd.repeated_passages(docs_of(rows)).collect()}
    assert {(5, 0, 70, 4), (8, 0, 70, 4)} <= got
    assert {g[0] for g in got} == {5, 6, 8} and max(g[2] for g in got if g[0] == 6) == 140
    assert sd.repeated_passages(docs_of([])).count() == 0
    assert sd.repeated_passages(docs_of([(1, same)])).count() == 0


def test_chain_is_split_at_its_gap(docs_of):
    """P + gap + Q against P + Q, either way round: P and Q are found although the gap is too much for one piece."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(50_000)]
    rows, wanted = [], []
    for n, size in enumerate((100, 200, 400) * 4):
        p, q = rng.choices(vocab, k=size), rng.choices(vocab, k=size)
        gap = rng.choices(vocab, k=int(size * rng.uniform(0.8, 1.3)))
        long, short = p + gap + q, p + q
        rows += [(2 * n, " ".join(long if n % 2 else short)), (2 * n + 1, " ".join(short if n % 2 else long))]
        at = size if n % 2 else size + len(gap)
        wanted += [(2 * n + 1, 0, size), (2 * n + 1, at, at + size)]
    got = sd.repeated_passages(docs_of(rows)).collect()
    for i, a, b in wanted:
        assert any(r["doc_id"] == i and r["start_word"] <= a and b <= r["end_word"] for r in got), (i, a, b)


def test_split_blocks_are_the_longest():
    """The first part taken is the longest accepted one of all, by trying each."""
    rng = random.Random(10)
    for _ in range(300):
        blocks, edits, at = [], [], 0
        for _ in range(rng.randint(1, 9)):
            size = rng.randint(8, 60)
            blocks.append([at, at + size, 0, 0])
            at += size + rng.randint(0, 30)
            edits.append(rng.randint(0, 40))
        edits.pop()
        fits = [(blocks[j][1] - blocks[i][0]) for i in range(len(blocks)) for j in range(i, len(blocks)) if sd.accepted(blocks[i][0], blocks[j][1], sum(edits[i:j]))]
        parts = sd.split_blocks(blocks, edits)
        assert max(blocks[j][1] - blocks[i][0] for i, j in parts) == max(fits)
        assert sorted(x for i, j in parts for x in range(i, j + 1)) == list(range(len(blocks)))


def test_recall_of_edited_passages(docs_of):
    """Passages of 60 words with a changed word at every 20th or 10th place, and with words changed, inserted and deleted at random."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(50_000)]

    def edited(words, every, kind):
        out = []
        for i, w in enumerate(words):
            hit = i % every == every // 2 if kind == "even" else rng.random() < 1 / every
            what = "change" if kind == "even" else rng.choice(["change", "insert", "delete"])
            out += [w] if not hit else {"change": ["new"], "insert": [w, "new"], "delete": []}[what]
        return out

    cases, rows, wanted = [(every, kind) for every in (20, 10) for kind in ("even", "any")], [], {}
    for n in range(160):
        passage = rng.choices(vocab, k=60)
        other = edited(passage, *cases[n % 4])
        rows += [(2 * n, " ".join(rng.choices(vocab, k=40) + passage + rng.choices(vocab, k=40)))]
        rows += [(2 * n + 1, " ".join(rng.choices(vocab, k=50) + other + rng.choices(vocab, k=30)))]
        wanted[2 * n + 1] = (cases[n % 4], 50, 50 + len(other))
    hits = dict.fromkeys(cases, 0)
    for r in sd.repeated_passages(docs_of(rows)).collect():
        case, a, b = wanted[r["doc_id"]]
        hits[case] += min(b, r["end_word"]) - max(a, r["start_word"]) >= 0.7 * (b - a)
    assert hits[20, "even"] == 40 and hits[10, "even"] >= 38 and hits[20, "any"] >= 36 and hits[10, "any"] >= 28


def test_first_places_in_fragments(docs_of):
    """What two later documents share is found although its seeds first stand in short fragments elsewhere."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(50_000)]
    own = lambda: rng.choices(vocab, k=30)
    rows, wanted = [], set()
    for n in range(0, 400, 10):
        line, passage = rng.choices(vocab, k=15), rng.choices(vocab, k=60)
        rows += [(n + 1, " ".join(own() + line + own()))]
        rows += [(n + k, " ".join(own() + line * 5 + own())) for k in (5, 9)]
        wanted.add((n + 9, 30, 105))
        # an earlier document has all parts of the passage, none longer than 19 words; one between the two has them too
        for k in (2, 7):
            parts = [passage[p : p + 19] for p in range(0, 60, 8)]
            rows += [(n + k, " ".join(sum((part + own() for part in rng.sample(parts, len(parts))), [])))]
        rows += [(n + k, " ".join(own() + passage + own())) for k in (6, 8)]
        wanted.add((n + 8, 30, 90))
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in sd.repeated_passages(docs_of(rows)).collect()}
    assert all(any(d == i and x <= a and b <= y for i, x, y in got) for d, a, b in wanted)
    truth = exact_windows(rows, 50)
    assert len(truth) > 400 and all(any(d == i and a <= p and p + 50 <= b for d, a, b in got) for i, p in truth)


def test_run_hashes():
    words = np.random.default_rng(1).integers(-(2**31), 2**31, 500).astype(np.int32)
    both = sd.run_hashes(np.concatenate([words, words[::-1], words]))
    plain = sd.run_hashes(words)
    assert len(plain) == 451 and (both[:451] == plain).all() and (both[1000:] == plain).all() and len(set(both.tolist())) == 1451 - 451
    assert len(sd.run_hashes(words[:49])) == 0 and len(sd.run_hashes(words[:50])) == 1


def test_edit_distance_is_exact():
    """Against the whole table, for runs of all lengths; long runs that differ by little cost little."""
    rng = np.random.default_rng(5)

    def table(a, b):
        now = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            new = np.empty_like(now)
            new[0] = i
            for j, y in enumerate(b, 1):
                new[j] = min(now[j] + 1, new[j - 1] + 1, now[j - 1] + (x != y))
            now = new
        return int(now[-1])

    for n, m in [(0, 0), (0, 5), (1, 1), (3, 40), (20, 20), (60, 45), (120, 119)]:
        for size in (2, 5, 1000):
            a, b = rng.integers(0, size, n).astype(np.int32), rng.integers(0, size, m).astype(np.int32)
            assert sd.edit_distance(a, b) == sd.edit_distance(b, a) == table(a, b)
    long = rng.integers(0, 1 << 30, 3000).astype(np.int32)
    assert sd.edit_distance(long, np.concatenate([long[:1000], long[:2], long[1000:]])) == 2
    assert sd.edit_distance(long, np.delete(long, [5, 700, 2000])) == 3
    assert sd.edit_distance(long[:400], long[400:800]) == 400


def test_repeated_ids(docs_of):
    """Of rows that share an id the one with the least text is read, whatever the order."""
    words = [f"a{i}" for i in range(80)]
    passage = " ".join(words)
    rows = [(1, "x " + passage), (2, passage + " tail"), (2, "zz other"), (2, "zz other"), (3, "a first"), (3, passage)]
    got = {(r["doc_id"], r["n_words"], r["first_id"]) for r in sd.repeated_passages(docs_of(rows)).collect()}
    assert got == {(2, 80, 1)}
    assert sd.repeated_passages(docs_of([])).count() == 0


def test_lone_links_as_one_by_one():
    """Chains of one link, aligned many at a time, give what align_chain gives for each, where no words off the diagonal agree."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    cols = {c: [] for c in ("places", "firsts", "here", "there")}
    lo = {"here": [], "there": []}
    expected = []
    for _ in range(600):
        size = int(rng.choice([3, 30, 1000]))
        here, there = rng.integers(0, size, rng.integers(8, 110)).astype(np.int32), rng.integers(0, size, rng.integers(8, 110)).astype(np.int32)
        p, q = int(rng.integers(0, len(here) - 7)), int(rng.integers(0, len(there) - 7))
        n = min(len(here) - p, len(there) - q, int(rng.integers(8, 70)))
        there[q : q + n] = here[p : p + n]
        for _ in range(int(rng.integers(0, 6))):
            there[int(rng.integers(0, len(there)))] = -1
        there[q : q + 8] = here[p : p + 8]
        a, b = int(rng.integers(0, 50)), int(rng.integers(0, 50))
        for c, v in zip(cols, ([p + a], [q + b], here, there), strict=True):
            cols[c].append(v)
        lo["here"].append(a)
        lo["there"].append(b)
        expected.append(sd.align_chain([(p + a, q + b)], here, a, there, b)[0])
    lists = {c: sd.Lists(pa.array([list(map(int, x)) for x in v], pa.list_(pa.int32()))) for c, v in cols.items()}
    rows = np.arange(600)
    pieces, final = sd.align_lone(rows, lists["places"], lists["firsts"], lists["here"], np.array(lo["here"]), lists["there"], np.array(lo["there"]))
    assert final.sum() > 300
    for k in rows[final]:
        assert tuple(pieces[k].tolist()) == expected[k]


def test_seeds_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(3)
    lengths = [0, 3, 7, 8, 9, 10, 11, 12, 40, 0, 200]
    starts = np.cumsum([0, *lengths])
    words = rng.integers(0, 50, starts[-1]).astype(np.uint64)
    seeds, texts, places = sd.minimizers(words, starts)
    expected = []
    for i in range(len(lengths)):
        g = sd.kmers(words[starts[i] : starts[i + 1]])
        for x in range(max(1, len(g) - sd.PICK + 1) if len(g) else 0):
            at = x + int(g[x : x + sd.PICK].argmin())
            expected.append((i, at, int(g[at])))
    assert sorted(set(expected)) == sorted(zip(texts.tolist(), places.tolist(), seeds.tolist(), strict=True))


def test_each_place_of_a_seed_leads_to_its_first(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(s), int(i), int(p)) for s, i, p in rng.integers(0, [40, 30, 500], (5000, 3))} | {(7, 1000 + i, 0) for i in range(25_000)})
    firsts = {}
    for s, i, p in rows:
        firsts.setdefault(s, (i, p))
    expected = sorted((i, p, *firsts[s]) for s, i, p in rows if i != firsts[s][0])
    seeds = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "seed long, id long, pos int")
    links = sd.first_links(seeds, "bigint")
    assert "SortMergeJoin" not in links._jdf.queryExecution().toString()  # one pass over the seeds
    assert sorted(tuple(r) for r in links.collect()) == expected


def test_chains_of_plain_pairs_are_those_of_the_search(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], []
    for i in range(60):
        links = []
        for first in range(int(rng.integers(1, 4))):
            p = np.cumsum(rng.integers(1, 16 if i % 3 else 40, int(rng.integers(1, 12))))
            q = p + int(rng.integers(0, 9)) if i % 2 else rng.permutation(p)
            pairs = list(zip(p.tolist(), q.tolist(), strict=True))
            expected += [(i, first, [x for x, _ in c], [y for _, y in c]) for c in sd.chains(pairs)]
            links += [(x, first, y) for x, y in pairs]
        rows.append((i, [links[k] for k in rng.permutation(len(links))]))
    frame = spark.createDataFrame(rows, "id long, links array<struct<pos:int,first_id:long,first_pos:int>>")
    assert sorted(tuple(r) for r in sd.chain_links(frame, "bigint").collect()) == sorted(expected)
