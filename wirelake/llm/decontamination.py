"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words (punctuation off, A-Z lower-cased). A document leaks an item if some part of it is within k
word edits of the item, k = min(n // 5, (n - 3) // 3) for an item of n words.

Windows begin at every word of a document and are embedded by CGK random walks: at step j a walk writes the symbol under its pointer, which
then moves on or stays by a random bit of (walk, j, symbol). Small edit distance becomes small Hamming distance. Bands
sample coordinates of the embedding; all windows' bands are looked up in a table of the items' bands, and a window
that meets one is a candidate. An item has a window size, the largest of SIZES that it has room for (over half its words for
items of up to 63), and is entered by windows of that size at every half of it from its start to its end, so edits that crowd
in one place leave another window. Items of under SIZES[0] words are too short to sample: those have one edit at most, and are looked up by runs of three words (or
the whole item), which one edit can't all touch. Candidates get an exact semi-global edit distance.

Everything is a map over the documents; the benchmark is taken in blocks of bounded bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wirelake.llm.common import grams, mix, slices, stage, table

PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
#: Bytes of benchmark texts in one block; a longer item is a block by itself.
BLOCK_BYTES = 4 << 20
#: Window sizes, in words. Walks have 1.5 steps for each word of the window.
SIZES = (8, 16, 32)
#: Walks, bands of each walk and coordinates of each band: by measurement, 0.95 or more of the items at their largest distance are found.
WALKS, BANDS, SAMPLED = 3, 4, 3
#: Windows embedded at once, and cells of the edit-distance tables worked on at once.
PART, CELLS = 1 << 15, 1 << 18
PAD = np.uint64(0)


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def edits_allowed(n: int) -> int:
    return max(0, min(n // 5, (n - 3) // 3))


def window_size(n: int) -> int:
    """The window size of an item of n words; 0 for short items."""
    return max((s for s in SIZES if s <= n), default=0)


def steps_of(size: int) -> int:
    return size * 3 // 2


def coordinates(seed: int = 7) -> dict[int, list[list[list[int]]]]:
    """By window size and walk, the steps that each band samples: different ones, apart from each other."""
    rng = np.random.default_rng(seed)
    return {s: [[sorted(rng.choice(steps_of(s), SAMPLED, replace=False).tolist()) for _ in range(BANDS)] for _ in range(WALKS)] for s in SIZES}


def walk_bits(symbols: np.ndarray, walk: int) -> list[np.ndarray]:
    """Random bits of (walk, step, symbol): bit j % 64 of the array j // 64 says whether the pointer moves on at step j."""
    out = []
    for k in range(-(-steps_of(SIZES[-1]) // 64)):
        out.append(mix(symbols + np.uint64((0x9E3779B97F4A7C15 * (walk * 64 + k + 1)) & (2**64 - 1))))
    return out


def band_keys(symbols: np.ndarray, count: int, sizes: list[int], sampled: dict[int, list[list[list[int]]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, key, whether two sampled symbols differ), band by band, for the windows that begin at the first count symbols; PAD follows the symbols.

    A walk is the same for all sizes, so it is walked once.
    """
    last = max((max(band) for s in sizes for walk in sampled[s] for band in walk), default=-1)
    padded = np.concatenate([symbols, np.full(last + 2, PAD)])
    moves, first = np.empty(count, np.uint64), np.arange(count)
    for walk in range(WALKS):
        bits = walk_bits(padded, walk)
        wanted = {j for s in sizes for band in sampled[s][walk] for j in band}
        at, met = first.copy(), {}
        for j in range(max(wanted, default=-1) + 1):
            if j in wanted:
                met[j] = padded.take(at)
            bits[j // 64].take(at, out=moves, mode="clip")  # clip spares a check of bounds, which at never passes
            np.right_shift(moves, np.uint64(j % 64), out=moves)
            np.bitwise_and(moves, np.uint64(1), out=moves)
            at += moves.view(np.int64)
        for s in sizes:
            for b, band in enumerate(sampled[s][walk]):
                key = met[band[0]] + np.uint64(walk * 64 + b + 1)
                differ = np.zeros(count, bool)
                for j in band[1:]:
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                    key += met[j]
                    differ |= met[j] != met[band[0]]
                key *= np.uint64(0xD6E8FEB86659FD93)
                yield s, key, differ


class Table:
    """Band keys of one size, sorted, with the windows that have them, behind a filter."""

    def __init__(self, keys: list[np.ndarray], windows: list[np.ndarray]):
        key, window = np.concatenate(keys), np.concatenate(windows)
        order = np.argsort(key, kind="stable")
        self.keys, self.windows = key[order], window[order]
        self.shift = np.uint64(64 - max(16, min(26, int(16 * len(key)).bit_length())))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all matches."""
        hits = np.flatnonzero(self.filter.take((keys >> self.shift).view(np.int64)) & allowed)
        first, end = np.searchsorted(self.keys, keys[hits], "left"), np.searchsorted(self.keys, keys[hits], "right")
        times = end - first
        place = np.repeat(hits, times)
        return place, self.windows[np.repeat(first, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)]


class Items:
    """A block of the benchmark, ready to be matched: word hashes, the table of bands, runs of short items. Memory goes with its words."""

    def __init__(self, texts: list[bytes], seed: int = 7):
        rows = [(i, hashed(w)) for i, t in enumerate(texts) if (w := plain_words(t))]
        self.rows = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.allowed = np.array([edits_allowed(n) for n in self.lengths], np.int64)
        self.sampled = coordinates(seed)
        self.tables: dict[int, Table] = {}
        self.owner: dict[int, np.ndarray] = {}  # by size, each window's item and place in it
        self.place: dict[int, np.ndarray] = {}
        for size in SIZES:
            keys, windows, owner, place = [], [], [], []
            for i, w in enumerate(self.words):
                if window_size(len(w)) != size:
                    continue
                begins = sorted({*range(0, len(w) - size + 1, size // 2), len(w) - size})
                for _, key, differ in band_keys(w, len(w), [size], self.sampled):
                    good = [b for b in begins if differ[b]]
                    keys.append(key[good])
                    windows.append(np.array([len(owner) + begins.index(b) for b in good], np.int64))
                owner += [i] * len(begins)
                place += begins
            if keys:
                self.tables[size] = Table(keys, windows)
                self.owner[size], self.place[size] = np.array(owner, np.int64), np.array(place, np.int64)
        runs = defaultdict(list)
        for i, w in enumerate(self.words):
            if not window_size(len(w)):
                for at, g in enumerate(grams(w, min(3, len(w)))):
                    runs[min(3, len(w)), int(g)].append((i, at))
        self.runs = {}
        for size in {s for s, _ in runs}:
            keys = np.array(sorted(g for s, g in runs if s == size), np.uint64)
            self.runs[size] = keys, [runs[size, int(g)] for g in keys]

    def short(self, stream: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, start within the text) wherever a run of a short item occurs."""
        for size, (keys, places) in self.runs.items():
            g = grams(stream, size)
            spot = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hits = np.flatnonzero(keys[spot] == g)
            text = np.searchsorted(starts, hits, "right") - 1
            for p, t in zip(hits.tolist(), text.tolist(), strict=True):
                if p + size <= starts[t + 1]:
                    for item, offset in places[spot[p]]:
                        yield t, item, p - int(starts[t]) - offset

    def candidates(self, stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, start within the text); places that differ by less than 8 words are one, the first."""
        found = [np.array(list(self.short(stream, starts)), np.int64).reshape(-1, 3)]
        for lo in range(0, len(stream), PART):
            part = stream[lo : lo + PART + steps_of(SIZES[-1])]
            count = min(PART, len(stream) - lo)
            for size, key, differ in band_keys(part, count, list(self.tables), self.sampled):
                place, window = self.tables[size].find(key, differ)
                if len(place):
                    text = np.searchsorted(starts, place + lo, "right") - 1
                    found.append(np.stack([text, self.owner[size][window], place + lo - starts[text] - self.place[size][window]], axis=1))
        out = np.concatenate(found)
        out[:, 2] -= out[:, 2] % 8
        return np.unique(out, axis=0)

    def absent(self, region: np.ndarray, items: np.ndarray) -> np.ndarray:
        """How many words of each item its region doesn't have anywhere: never more than the edits."""
        out = np.zeros(len(items), np.int64)
        for k, i in enumerate(items.tolist()):
            if self.lengths[i] > 256:
                out[k] = np.count_nonzero(~np.isin(self.words[i], region[k]))
        short = np.flatnonzero(self.lengths[items] <= 256)
        if len(short):
            words = self.padded(items[short])
            for lo in range(0, len(short), 64):
                there = (words[lo : lo + 64, :, None] == region[short[lo : lo + 64], None, :]).any(axis=2)
                out[short[lo : lo + 64]] = np.count_nonzero(~there & (np.arange(words.shape[1])[None, :] < self.lengths[items[short[lo : lo + 64]]][:, None]), axis=1)
        return out

    def padded(self, items: np.ndarray) -> np.ndarray:
        words = np.full((len(items), int(self.lengths[items].max())), PAD)
        for k, i in enumerate(items.tolist()):
            words[k, : self.lengths[i]] = self.words[i]
        return words

    def distances(self, region: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edit distance of each item to any part of its region, and where that part ends."""
        words = self.padded(items)
        cols = np.arange(region.shape[1] + 1, dtype=np.int32)
        now = np.zeros((len(region), len(cols)), np.int32)
        best, end = np.full(len(region), 1 << 30), np.zeros(len(region), np.int64)
        for i in range(words.shape[1]):
            own = words[:, i][:, None]
            step = np.empty_like(now)
            step[:, 0] = now[:, 0] + 1
            step[:, 1:] = np.minimum(now[:, :-1] + (region != own), now[:, 1:] + 1)
            step -= cols
            now = np.minimum.accumulate(step, axis=1, out=step)
            now += cols
            last = self.lengths[items] == i + 1
            if last.any():
                end[last] = now[last].argmin(axis=1)
                best[last] = now[last].min(axis=1)
        return best, end

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, row of the item, distance, first word, end word) of the best part for each text and item that leaks."""
        if not self.rows:
            return []
        words = [plain_words(t) for t in texts]
        starts = np.zeros(len(words) + 1, np.int64)
        starts[1:] = np.cumsum([len(w) for w in words])
        stream = hashed([w for part in words for w in part])
        if not len(stream):
            return []
        found = self.candidates(stream, starts)
        found = found[np.argsort(self.lengths[found[:, 1]], kind="stable")]
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        lo = 0
        while lo < len(found):
            # items of like length together, as many as CELLS allows; the last of a batch is its longest
            widths = self.lengths[found[lo : lo + 4096, 1]] + 3 * self.allowed[found[lo : lo + 4096, 1]] + 8
            n = max(1, int(np.searchsorted(widths * np.arange(1, len(widths) + 1), CELLS)))
            t, it, f = found[lo : lo + n].T
            lo += n
            # the item may begin up to its edits before or after f .. f + 7
            k = self.allowed[it]
            begin = f - k
            width = self.lengths[it] + 3 * k + 8
            at = begin[:, None] + np.arange(int(width.max()))[None, :]
            size = (starts[t + 1] - starts[t])[:, None]
            inside = (at >= 0) & (at < size) & (np.arange(at.shape[1])[None, :] < width[:, None])
            region = np.where(inside, stream[np.where(inside, at + starts[t][:, None], 0)], PAD)
            if not len(close := np.flatnonzero(self.absent(region, it) <= k)):
                continue
            t, it, k, begin, region = t[close], it[close], k[close], begin[close], region[close]
            best, end = self.distances(region, it)
            for j in np.flatnonzero(best <= k).tolist():
                last = int(begin[j] + end[j])
                key, value = (int(t[j]), self.rows[int(it[j])]), (int(best[j]), max(0, last - int(self.lengths[it[j]])), last)
                if key not in out or value < out[key]:
                    out[key] = value
        return [(*key, *value) for key, value in sorted(out.items())]


def blocks_of(benchmark: DataFrame) -> Iterator[tuple[list, list[bytes]]]:
    """The benchmark's ids and texts in blocks of BLOCK_BYTES at most (or one item), streamed to the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = row[1].encode()
        if texts and size + len(text) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, item_words, start_word, end_word): one row for each row of docs and item that it leaks.

    start_word is end_word less the item's words. Null and empty texts and items match nothing; repeated rows each give their rows,
    repeated items too; null ids are carried, and ids may have any type. Texts are read whole; of a text's ties the first part
    counts. An item of any length is matched: its edit distance costs its length squared. Other columns are ignored; an empty
    table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"`{id_col}` {kind}, item_id {item_type.simpleString()}, distance int, item_words int, start_word int, end_word int"
    arrow_type = to_arrow_type(item_type)
    out = None
    for block in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            items = Items(texts)
            lengths = dict(zip(items.rows, items.lengths.tolist(), strict=True))
            for batch in batches:
                for part, own in slices(batch):
                    found = items.leaks(own)
                    col = lambda i: pa.array([f[i] for f in found], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([ids[f[1]] for f in found], arrow_type), col(2), pa.array([lengths[f[1]] for f in found], pa.int32()), col(3), col(4)],
                        names=[id_col, "item_id", "distance", "item_words", "start_word", "end_word"],
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else stage(out.unionByName(found), "leaks")  # one block's broadcast at a time
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that leak an item: a map over the scan, all columns as they are. Each row is judged by its own text."""
    for block in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value[1])
            for batch in batches:
                for part, texts in slices(batch, text_col):
                    bad = {f[0] for f in items.leaks(texts)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())) if bad else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
