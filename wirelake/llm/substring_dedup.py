"""Fuzzy repeated passages: shared k-mer seeds, collinear chaining, alignment of chains.

Seeds are the minimizers of each text's word k-mers. A seed links each of its places with its first place
in the corpus (smallest id, then position), so a seed of n places gives n links, not n squared. For each
pair of documents the links are chained: a chain takes links in order of both positions, at a cost for the gaps
between them, and the best one is found by a Fenwick tree over the other document's positions.
Chains are aligned word by word, between their links and outwards; aligned pieces of one
document that touch, whichever first documents they lead to, make a passage. A first place may be a mere
fragment of what two later documents share, so an exact pass follows: runs of PASSAGE_WORDS words
whose seeds are all shared and that no passage covers are looked up among the runs of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.common import collect_bitmap, in_bitmap, mix, slices, stage_alone, table, word_stream

#: Words in a seed, and seeds among which the least is chosen: any run of K + PICK - 1 equal words shares a seed.
K, PICK = 8, 4
#: What a link adds to a chain, and what a word of gap takes from it.
LINK, GAP = 8.0, 0.5
#: Words beyond a chain's ends that alignment may take in.
FLANK = 48
#: Extension stops when its score (1 for a word that agrees, -MISS otherwise) falls by DROP.
MISS, DROP = 2, 8
#: After words inserted or deleted, extension looks for AGREE equal words that begin within REACH words.
REACH, AGREE = 4, 4
#: Least words of an aligned piece, least share of words that agree, and most words between pieces that touch.
PIECE_WORDS, IDENTITY, TOUCH = 20, 0.7, 8
#: Least words of a passage.
PASSAGE_WORDS = 50


def kmers(words: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each run of K words (a power of two): hashes of halves are mixed."""
    h, size = words, 1
    if len(words) < K:
        return np.zeros(0, np.uint64)
    while size < K:
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    return h


def minimizers(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, position): the least hash of each window of PICK k-mers of each text; one window if a text has fewer."""
    g = kmers(words)
    n, most = len(g), np.uint64(2**64 - 1)
    lengths = np.diff(starts)
    text = np.repeat(np.arange(len(lengths)), lengths)[:n]
    place, count = np.arange(n) - starts[text], np.maximum(lengths - K + 1, 0)[text]
    g = np.concatenate([np.where(place < count, g, most), np.full(PICK - 1, most)])
    begin = np.flatnonzero((place <= count - PICK) | ((place == 0) & (count > 0)))
    best, at = g[begin], begin
    for j in range(1, PICK):
        other = g[begin + j]
        less = other < best
        best, at = np.where(less, other, best), np.where(less, begin + j, at)
    chosen = np.zeros(n, bool)
    chosen[at] = True
    at = np.flatnonzero(chosen)
    return g[at], text[at], place[at]


class Fenwick:
    """Prefix maxima of (score, link) over positions."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def top(self, before: int) -> tuple[float, int]:
        """The best over positions 0 .. before - 1."""
        out = (-1e18, -1)
        while before > 0:
            out = max(out, self.best[before])
            before -= before & -before
        return out


def chains(links: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of links (position here, position there), best first; each of two links or more, or a lone link."""
    links = sorted(set(links))
    order = {p: i for i, p in enumerate(sorted({q for _, q in links}))}
    tree = Fenwick(len(order))
    score, before = [0.0] * len(links), [-1] * len(links)
    i = 0
    while i < len(links):
        j = i
        while j < len(links) and links[j][0] == links[i][0]:  # links at one position don't precede each other
            p, q = links[j]
            best, at = tree.top(order[q])
            gain = best - GAP * (p + q) / 2
            score[j], before[j] = (LINK + gain, at) if at >= 0 and gain > 0 else (LINK, -1)
            j += 1
        for n in range(i, j):
            p, q = links[n]
            tree.put(order[q], (score[n] + GAP * (p + q) / 2, n))
        i = j
    used, out = [False] * len(links), []
    for n in sorted(range(len(links)), key=lambda n: -score[n]):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(links[n])
            n = before[n]
        if chain:
            out.append(chain[::-1])
    return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word edits between two runs of any length: exact within a band about the diagonal, which widens until it holds the answer."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    most = max(16, len(b) - len(a))
    while True:
        # cell c of row i stands for i words of a against i - most + c words of b; far is more than any distance
        width, far = 2 * most + 1, len(a) + len(b) + 1
        cols = np.arange(width)
        other = np.concatenate([np.full(most, -1, np.int64), b.astype(np.int64) & 0xFFFFFFFF, np.full(most + 1, -1, np.int64)])
        now = np.where(cols >= most, cols - most, far)
        now[cols - most > len(b)] = far
        for i, x in enumerate((a.astype(np.int64) & 0xFFFFFFFF).tolist(), 1):
            at = i - most + cols  # words of b
            step = now + (other[i - 1 : i - 1 + width] != x)  # the band moves with the row, so a match stays in its cell
            step[:-1] = np.minimum(step[:-1], now[1:] + 1)
            step[at == 0] = i
            step[(at < 0) | (at > len(b))] = far
            now = np.minimum(np.minimum.accumulate(step - cols) + cols, far)
            now[(at < 0) | (at > len(b))] = far
        found = int(now[len(b) - len(a) + most])
        if found <= most or most >= len(b):
            return found
        most *= 2


def diagonal(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to take in from the start of both, and how many of them disagree."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    score = np.cumsum(np.where(a[:n] == b[:n], 1, -MISS))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    stop = int(fallen[0]) if len(fallen) else n
    if stop == 0:
        return 0, 0
    best = int(score[:stop].argmax())
    if score[best] <= 0:
        return 0, 0
    return best + 1, int((a[: best + 1] != b[: best + 1]).sum())


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words to take in from the start of a and of b, and their edits; words may be changed, inserted or deleted."""
    n, edits = diagonal(a, b)
    m = n
    while True:
        same = a[n : n + REACH + AGREE, None] == b[None, m : m + REACH + AGREE]
        if np.count_nonzero(same) < AGREE:
            return n, m, edits
        high, wide = (max(0, size - AGREE + 1) for size in same.shape)
        runs = np.ones((high, wide), bool)  # where AGREE equal words begin
        for k in range(AGREE):
            runs &= same[k : k + high, k : k + wide]
        spots = np.argwhere(runs)
        if not len(spots):
            return n, m, edits
        i, j = min(spots.tolist(), key=max)
        more, miss = diagonal(a[n + i :], b[m + j :])
        if more - miss - MISS * (miss + max(i, j)) <= 0:
            return n, m, edits
        n, m, edits = n + i + more, m + j + more, edits + miss + max(i, j)


def chain_blocks(chain: list[tuple[int, int]], here: np.ndarray, here_lo: int, there: np.ndarray, there_lo: int) -> tuple[list[list[int]], list[int]]:
    """The chain's runs of equal words, as [start, end, first start, first end], and the edits between each two of them."""
    p, q = chain[0]
    blocks, edits = [[p, p + K, q, q + K]], []
    for p2, q2 in chain[1:]:
        end, other_end = blocks[-1][1], blocks[-1][3]
        if p2 - p == q2 - q and p2 <= end:  # overlapping seeds on one diagonal agree throughout
            blocks[-1][1], blocks[-1][3] = p2 + K, q2 + K
        else:
            if p2 >= end and q2 >= other_end:
                a, b = here[end - here_lo : p2 - here_lo], there[other_end - there_lo : q2 - there_lo]
                edits.append(int((a != b).sum()) if len(a) == len(b) and (a == b).mean() > 0.5 else edit_distance(a, b))
            else:  # seeds overlap on one side only: the difference is inserted or deleted
                edits.append(abs((p2 - p) - (q2 - q)))
            blocks.append([p2, p2 + K, q2, q2 + K])
        p, q = p2, q2
    return blocks, edits


def accepted(start: int, end: int, edits: int) -> bool:
    return edits <= (end - start) * (1 - IDENTITY)


def split_blocks(blocks: list[list[int]], edits: list[int]) -> list[tuple[int, int]]:
    """(first block, last block) of disjoint parts that are accepted by themselves, the longest first among those that can still be had.

    A part is accepted if its words here times 1 - IDENTITY, less its edits, are not under 0: the difference of two prefix
    sums. Gaps that no accepted part can span cut the chain beforehand.
    """
    n = len(blocks)
    own = [(1 - IDENTITY) * (b[1] - b[0]) for b in blocks]
    gap = [(1 - IDENTITY) * (blocks[i + 1][0] - blocks[i][1]) - edits[i] for i in range(n - 1)]
    left, right = list(own), list(own)  # the best sum of a part that ends, or begins, at a block
    for i in range(1, n):
        left[i] += max(0.0, left[i - 1] + gap[i - 1])
    for i in range(n - 2, -1, -1):
        right[i] += max(0.0, right[i + 1] + gap[i])
    cuts = [i + 1 for i in range(n - 1) if left[i] + gap[i] + right[i + 1] < -1e-9]
    todo, out = list(zip([0, *cuts], [*cuts, n], strict=True)), []
    while todo:
        lo, hi = todo.pop()
        before, total, low = [], 0.0, []  # sums before each block; blocks whose sum before is a new low
        for i in range(lo, hi):
            before.append(total)
            if not low or total < before[low[-1] - lo]:
                low.append(i)
            total += own[i] + (gap[i] if i + 1 < hi else 0.0)
        best = (0, lo, lo)
        for j in range(hi - 1, lo - 1, -1):  # the longest part that ends at j begins at one of the lows
            after = before[j - lo] + own[j]
            while low and after - before[low[-1] - lo] >= -1e-9:
                i = low.pop()
                best = max(best, (blocks[j][1] - blocks[i][0], i, j))
        _, i, j = best
        out.append((i, j))
        todo += [part for part in ((lo, i), (j + 1, hi)) if part[0] < part[1]]
    return sorted(out)


def align_chain(chain: list[tuple[int, int]], here: np.ndarray, here_lo: int, there: np.ndarray, there_lo: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, first start, first end, edits) of each aligned piece of the chain, in words of both documents.

    The whole chain is one piece if its edits allow that; else it is split at gaps, and each part stands by itself.
    """
    blocks, edits = chain_blocks(chain, here, here_lo, there, there_lo)

    def piece(i: int, j: int) -> tuple[int, int, int, int, int]:
        start, end, other, other_end = blocks[i][0], blocks[j][1], blocks[i][2], blocks[j][3]
        plain = (start, end, other, other_end, sum(edits[i:j]))
        ahead, ahead_there = here[end - here_lo :][:FLANK], there[other_end - there_lo :][:FLANK]
        more, more_there, miss = extend(ahead, ahead_there)
        less, less_there, miss2 = extend(here[: start - here_lo][::-1][:FLANK], there[: other - there_lo][::-1][:FLANK])
        wide = (start - less, end + more, other - less_there, other_end + more_there, plain[4] + miss + miss2)
        return wide if accepted(wide[0], wide[1], wide[4]) or not accepted(*plain[:2], plain[4]) else plain

    whole = piece(0, len(blocks) - 1)
    if len(blocks) == 1 or accepted(whole[0], whole[1], whole[4]):
        return [whole]
    return [piece(i, j) for i, j in split_blocks(blocks, edits)]


def seeds_of(rows: DataFrame, kind: str) -> DataFrame:
    """(seed, id, pos) of all rows with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                seeds, owner, places = minimizers(*word_stream(texts))
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), part.column("id").take(pa.array(owner)), pa.array(places.astype(np.int32))], names=["seed", "id", "pos"])

    return rows.where("id is not null").mapInArrow(run, f"seed long, id {kind}, pos int")


def first_links(seeds: DataFrame, kind: str) -> DataFrame:
    """(id, pos, first_id, first_pos): each place of a seed (seed, id, pos) with the seed's first place, where that is in another document.

    The places of a seed come one after another in their order, so one row is kept in mind whatever a seed's number of places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the first place of the last seed
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*kept, batch]).combine_chunks()
            seed, ids, pos = (rows.column(c).chunk(0) for c in ("seed", "id", "pos"))
            seed = seed.to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            first = np.repeat(begin, np.diff(np.append(begin, len(seed))))
            later = np.flatnonzero(first != np.arange(len(seed)))
            own, other = pa.array(later), pa.array(first[later])
            out = pa.RecordBatch.from_arrays([ids.take(own), pos.take(own), ids.take(other), pos.take(other)], names=["id", "pos", "first_id", "first_pos"])
            yield out.filter(pc.not_equal(out.column("id"), out.column("first_id")))
            kept = rows.slice(int(first[-1]), 1).combine_chunks().to_batches()

    in_order = seeds.repartition("seed").sortWithinPartitions("seed", "id", "pos")
    return in_order.mapInArrow(run, f"id {kind}, pos int, first_id {kind}, first_pos int")


def word_arrays(rows: DataFrame, kind: str, wanted: DataFrame) -> DataFrame:
    """(id, words): 32-bit word hashes of the wanted ids; a bitmap thins the scan, an exact semi-join follows."""
    bitmap = collect_bitmap(wanted, F.xxhash64("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            keep = in_bitmap(bits, batch.column("h").to_numpy())
            batch = batch.filter(pa.array(keep))
            for part, texts in slices(batch):
                hashes, starts = word_stream(texts)
                low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                words = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(low))
                yield pa.RecordBatch.from_arrays([part.column("id"), words], names=["id", "words"])

    found = rows.where("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(run, f"id {kind}, words array<int>")
    return found.join(wanted, "id", "left_semi")


def chain_links(links: DataFrame, kind: str) -> DataFrame:
    """(id, first_id, places, firsts) from (id, links): every chain of every pair of documents.

    Links of a pair on one diagonal, each less than LINK / GAP words after the one before, are one chain whatever else holds:
    each raises the score, and the one before is the best to come from. Other pairs' chains are looked for.
    """
    near = LINK / GAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = batch.column("id"), batch.column("links")
            flat = dict(zip((f.name for f in found.type.value_type), found.flatten().flatten(), strict=True))
            p, q = (flat[c].to_numpy().astype(np.int64) for c in ("pos", "first_pos"))
            if not len(p):
                continue
            firsts = flat["first_id"].dictionary_encode()
            row, other = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy())), firsts.indices.to_numpy()
            order = np.lexsort((q, p, other, row))
            p, q, row, other = p[order], q[order], row[order], other[order]
            begins = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])])
            step, shift = np.diff(p, prepend=0), np.diff(p - q, prepend=0)
            odd = ~begins & ((shift != 0) | (step <= 0) | (step >= near))
            begin = np.flatnonzero(begins)
            plain = np.add.reduceat(odd.astype(np.int64), begin) == 0
            size = np.diff(np.append(begin, len(p)))

            def rows(at: np.ndarray, places: np.ndarray, theirs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (places, theirs)]
                return pa.RecordBatch.from_arrays([own.take(pa.array(row[at])), firsts.dictionary.take(pa.array(other[at])), *lists], names=["id", "first_id", "places", "firsts"])  # noqa: B023

            inside = np.repeat(plain, size)
            yield rows(begin[plain], p[inside], q[inside], size[plain])
            at, chained = [], []
            for lo, n in zip(begin[~plain].tolist(), size[~plain].tolist(), strict=True):
                for chain in chains(list(zip(p[lo : lo + n].tolist(), q[lo : lo + n].tolist(), strict=True))):
                    at.append(lo)
                    chained.append(chain)
            both = np.array([x for chain in chained for x in chain], np.int64).reshape(-1, 2)
            yield rows(np.array(at, np.int64), both[:, 0], both[:, 1], np.array([len(c) for c in chained], np.int64))

    return links.mapInArrow(run, f"id {kind}, first_id {kind}, places array<int>, firsts array<int>")


class Lists:
    """A column of lists as one array with the places where each begins and ends."""

    def __init__(self, column: pa.ListArray):
        offsets = column.offsets.to_numpy().astype(np.int64)
        self.begin, self.end, self.values = offsets[:-1], offsets[1:], column.values.to_numpy()

    def __getitem__(self, row: int) -> np.ndarray:
        return self.values[self.begin[row] : self.end[row]]


def flank(words: Lists, rows: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, which exist) from the places at on, forwards or backwards, FLANK of them for each row."""
    index = at[:, None] + step * np.arange(FLANK)[None, :]
    inside = (index >= words.begin[rows][:, None]) & (index < words.end[rows][:, None])
    return words.values[np.where(inside, index, 0)], inside


def extend_all(here: tuple[np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What extend() does up to its first look for equal words off the diagonal, for many at once: (words taken in, edits, whether that look finds any)."""
    (a, a_in), (b, b_in) = here, there
    rows, valid = np.arange(len(a)), a_in & b_in
    equal = valid & (a == b)
    score = np.cumsum(np.where(equal, 1, -MISS), axis=1)
    fallen = (np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > DROP) | ~valid
    stop = np.where(fallen.any(axis=1), fallen.argmax(axis=1), FLANK)
    best = np.where(np.arange(FLANK)[None, :] < stop[:, None], score, -(1 << 30)).argmax(axis=1)
    taken = np.where((stop > 0) & (score[rows, best] > 0), best + 1, 0)
    missed = np.cumsum(~equal, axis=1)[rows, np.maximum(taken - 1, 0)] * (taken > 0)
    size = REACH + AGREE
    index = taken[:, None] + np.arange(size)[None, :]
    inside, index = index < FLANK, np.minimum(index, FLANK - 1)
    x, y = (m[rows[:, None], index] for m in (a, b))
    x_in, y_in = (m[rows[:, None], index] & inside for m in (a_in, b_in))
    same = (x[:, :, None] == y[:, None, :]) & x_in[:, :, None] & y_in[:, None, :]
    wide = size - AGREE + 1
    runs = np.ones((len(a), wide, wide), bool)
    for k in range(AGREE):
        runs &= same[:, k : k + wide, k : k + wide]
    return taken, missed, runs.any(axis=(1, 2))


def align_lone(rows: np.ndarray, places: Lists, firsts: Lists, here: Lists, here_lo: np.ndarray, there: Lists, there_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, which are final) of chains of one link: what align_chain() gives for them, unless words off the diagonal agree."""
    p, q = places.values[places.begin[rows]].astype(np.int64), firsts.values[firsts.begin[rows]].astype(np.int64)
    x, y = here.begin[rows] + p - here_lo[rows], there.begin[rows] + q - there_lo[rows]
    more, miss, off = extend_all(flank(here, rows, x + K, 1), flank(there, rows, y + K, 1))
    less, miss2, off2 = extend_all(flank(here, rows, x - 1, -1), flank(there, rows, y - 1, -1))
    edits = miss + miss2
    wide = edits <= (more + less + K) * (1 - IDENTITY)
    more, less, edits = (np.where(wide, v, 0) for v in (more, less, edits))
    return np.stack([p - less, p + K + more, q - less, q + K + more, edits], axis=1), ~(off | off2)


def align_all(both: DataFrame, kind: str) -> DataFrame:
    """Aligned pieces (id, first_id, start, end, first_start, first_end, edits) of PIECE_WORDS words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, firsts, here, there = (Lists(batch.column(c)) for c in ("places", "firsts", "here", "there"))
            here_lo, there_lo = (batch.column(c).to_numpy().astype(np.int64) for c in ("here_lo", "there_lo"))
            rows, out = [np.zeros(0, np.int64)], [np.zeros((0, 5), np.int64)]
            lone = np.flatnonzero(places.end - places.begin == 1)
            rest = np.flatnonzero(places.end - places.begin > 1)
            for lo in range(0, len(lone), 4096):
                part = lone[lo : lo + 4096]
                pieces, final = align_lone(part, places, firsts, here, here_lo, there, there_lo)
                rows.append(part[final])
                out.append(pieces[final])
                rest = np.concatenate([rest, part[~final]])
            for x in rest.tolist():
                chain = list(zip(places[x].tolist(), firsts[x].tolist(), strict=True))
                found = align_chain(chain, here[x], int(here_lo[x]), there[x], int(there_lo[x]))
                rows.append(np.full(len(found), x))
                out.append(np.array(found, np.int64).reshape(-1, 5))
            at, pieces = np.concatenate(rows), np.concatenate(out)
            long = pieces[:, 1] - pieces[:, 0] >= PIECE_WORDS
            at, pieces = pa.array(at[long]), pieces[long]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("first_id").take(at), *(pa.array(pieces[:, i].astype(np.int32)) for i in range(5))], names=["id", "first_id", "start", "end", "first_start", "first_end", "edits"])

    return both.mapInArrow(run, f"id {kind}, first_id {kind}, start int, end int, first_start int, first_end int, edits int")


def joined_pieces(found: list[dict]) -> list[list]:
    """[start, end, first id, edits] of the passages that pieces make.

    A piece continues a passage if it touches its end and is itself long enough, or leads to another first document or
    further on in the same one: shifted matches of one short repeated line with itself add up to nothing.
    """
    out: list[list] = []
    reached: dict = {}  # how far the open passage has come in each first document
    longest = 0
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        first, length = x["first_id"], x["end"] - x["start"]
        if out and x["end"] <= out[-1][1]:
            continue
        if out and x["start"] <= out[-1][1] + TOUCH and (length >= PASSAGE_WORDS or x["first_end"] > reached.get(first, -1)):
            out[-1][1] = x["end"]
            out[-1][3] += x["edits"]
            if length > longest:
                out[-1][2], longest = first, length
        else:
            out.append([x["start"], x["end"], first, x["edits"]])
            reached, longest = {}, length
        reached[first] = x["first_end"]
    return out


#: Base of the hashes of runs (odd, so that it has an inverse modulo 2**64), and bits of the filter of runs asked for.
BASE, RUN_BITS = 0x9E3779B97F4A7C15, 1 << 25


def run_hashes(words: np.ndarray) -> np.ndarray:
    """One hash for each run of PASSAGE_WORDS words: differences of a prefix sum, brought to the same power."""
    n = len(words) - PASSAGE_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def powers(base: int, count: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, base, np.uint64)]))

    mixed = mix(words.astype(np.int64).view(np.uint64) + np.uint64(BASE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(BASE, len(words)), dtype=np.uint64)])
    return mix((sums[PASSAGE_WORDS:] - sums[:n]) * powers(pow(BASE, -1, 1 << 64), n)).view(np.int64)


def open_runs(places: np.ndarray, spans: list[dict], n_words: int) -> np.ndarray:
    """Where runs of PASSAGE_WORDS words begin that an earlier document can have and no span covers.

    If an earlier document has a run, all seeds inside it are linked; they are at most PICK words apart, the first and the
    last less than PICK words from the first and last that the run has room for.
    """
    places = np.unique(places)
    breaks = np.flatnonzero(np.diff(places) > PICK) + 1
    wanted = np.zeros(max(0, n_words - PASSAGE_WORDS + 1), bool)
    for group in np.split(places, breaks):
        if len(group):
            wanted[max(0, int(group[0]) - PICK + 1) : max(0, int(group[-1]) + K + PICK - PASSAGE_WORDS)] = True
    for x in spans:
        wanted[x["start"] : max(0, x["end"] - PASSAGE_WORDS + 1)] = False
    return np.flatnonzero(wanted)


def uncovered_runs(asked: DataFrame, kind: str) -> DataFrame:
    """(id, start, run) from (id, words, places, spans): the open runs and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                words = batch.column("words")[row].values.to_numpy()
                at = open_runs(batch.column("places")[row].values.to_numpy(), spans or [], len(words))
                if len(at):
                    rows.append(np.full(len(at), row))
                    starts.append(at)
                    hashes.append(run_hashes(words)[at])
            own = batch.column("id")
            yield pa.RecordBatch.from_arrays([own.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes))], names=["id", "start", "run"])

    return asked.mapInArrow(run, f"id {kind}, start int, run long")


def first_runs(words: DataFrame, kind: str, wanted: DataFrame) -> DataFrame:
    """(run, first): the first place (id, start) of each wanted run, and of others that share a bit with one."""
    bitmap = collect_bitmap(wanted, F.col("run"), RUN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            rows, starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                found = run_hashes(batch.column("words")[row].values.to_numpy())
                at = np.flatnonzero(in_bitmap(bits, found))
                if len(at):
                    rows.append(np.full(len(at), row))
                    starts.append(at)
                    hashes.append(found[at])
            own = batch.column("id")
            yield pa.RecordBatch.from_arrays([own.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes))], names=["id", "start", "run"])

    return words.mapInArrow(run, f"id {kind}, start int, run long").groupBy("run").agg(F.min(F.struct("id", "start")).alias("first"))


def join_pieces(pieces: DataFrame, kind: str) -> DataFrame:
    """(id, start, end, first_id, edits): pieces of a document that overlap or nearly touch, joined; first_id is the longest piece's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, found in enumerate(batch.column("pieces").to_pylist()):
                joined = joined_pieces(found)
                rows += [row] * len(joined)
                out += joined
            own = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [own.take(pa.array(rows, pa.int64())), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], own.type), pa.array([o[3] for o in out], pa.int32())],
                names=["id", "start", "end", "first_id", "edits"],
            )

    return pieces.mapInArrow(run, f"id {kind}, start int, end int, first_id {kind}, edits int")


def one_row_for_each_id(rows: DataFrame) -> DataFrame:
    """rows (id, text) with the least text where an id repeats; rows as they are if none does."""
    repeated = stage_alone(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "substring-repeated")
    if repeated.isEmpty():
        return rows
    least = stage_alone(rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "substring-least")
    return rows.join(repeated, "id", "left_anti").unionByName(least)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words, first_id, edits): passages of a document that an earlier one has, exactly or nearly.

    Earlier means a smaller id; words are runs without ASCII white space after lower-casing A-Z. Passages have
    PASSAGE_WORDS words or more. Repeats within one document don't count. Null and empty texts and rows with a null
    id have no passages. Of rows that share an id one is read, that with the least text, as nothing tells their places apart. Texts may
    have any length; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = one_row_for_each_id(rows)
    links = first_links(seeds_of(rows, kind), kind).groupBy("id").agg(F.collect_list(F.struct("pos", "first_id", "first_pos")).alias("links"))
    found = stage_alone(chain_links(links, kind).withColumn("chain", F.monotonically_increasing_id()), "substring-chains")
    ends = [(F.col(c)[0], F.element_at(c, -1) + K) for c in ("places", "firsts")]
    low = [F.greatest(F.lit(0), a - FLANK) for a, _ in ends]
    asked = [found.select("chain", F.col(i).alias("id"), lo.alias("lo"), (b + FLANK).alias("hi")) for i, lo, (_, b) in zip(("id", "first_id"), low, ends, strict=True)]
    wanted = found.select("id").unionByName(found.select(F.col("first_id").alias("id"))).distinct()
    words = stage_alone(word_arrays(rows, kind, stage_alone(wanted, "substring-wanted")), "substring-words")
    here, there = (a.join(words, "id").select("chain", "lo", F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("part")) for a in asked)
    both = (
        found.join(here.withColumnsRenamed({"lo": "here_lo", "part": "here"}), "chain")
        .join(there.withColumnsRenamed({"lo": "there_lo", "part": "there"}), "chain")
        .select("id", "first_id", "places", "firsts", "here_lo", "here", "there_lo", "there")
    )
    length = F.col("end") - F.col("start")
    pieces = align_all(both, kind).where((length >= PIECE_WORDS) & (F.col("edits") <= length * (1 - IDENTITY)))
    listed = F.collect_list(F.struct("start", "end", "first_id", "first_end", "edits")).alias("pieces")
    near = stage_alone(join_pieces(pieces.groupBy("id").agg(listed), kind).where(length >= PASSAGE_WORDS), "substring-near")
    places = found.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"))
    spans = near.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    asked = stage_alone(uncovered_runs(words.join(places, "id").join(spans, "id", "left"), kind), "substring-runs")
    hits = asked.join(first_runs(words, kind, asked), "run").where("id > first.id")
    exact = hits.select("id", "start", (F.col("start") + PASSAGE_WORDS).alias("end"), F.col("first.id").alias("first_id"), (F.col("first.start") + PASSAGE_WORDS).alias("first_end"), F.lit(0).alias("edits"))
    both = near.withColumn("first_end", F.lit(-1)).unionByName(exact)
    passages = join_pieces(both.groupBy("id").agg(listed), kind)
    return passages.select(F.col("id").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), length.alias("n_words"), "first_id", "edits")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
