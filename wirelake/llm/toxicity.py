"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed rows: two for the word, two for its first four letters. Filters of
widths 1, 2 and 3 slide over the words; the maximum over the whole text of each filter goes through a ReLU into a logistic
output. Training also sees short cuts of clean texts as clean, down to no words at all, so that a text isn't toxic for want of
words. For a trained network a filter's response is a sum of one number for each word and offset, so
scoring gathers rows of precomputed tables.

Thresholds are calibrated for each language on the sample's calibration part; they make the column
toxic, and never touch the score. Labels, lang, source and doc_id aren't inputs of the score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from wirelake.llm.common import slices, table

#: Training takes at most this many labelled rows of each class, those of the smallest hash.
SAMPLE_PER_CLASS = 1500
#: Bytes of text in the training sample.
SAMPLE_BYTES = 64 << 20
ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
UPDATES, BATCH, RATE, DECAY = 1000, 32, 0.12, 1e-4
#: Short cuts of clean texts in each block, and their most words.
CUTS, CUT_WORDS = 8, 16
PREFIX = 4
#: Texts of the sample that must use an embedding row for it to be learnt.
MIN_TEXTS = 4
PUNCTUATION = b".,;:!?\"'()[]{}<>*#%$&_-"
#: Words whose responses a worker keeps; a full table starts anew.
MEMO = 200_000


def word_rows(word: bytes) -> tuple[int, int, int, int]:
    """The four embedding rows of a word: two hashes of it, two of its prefix."""
    core = word.strip(PUNCTUATION) or word
    head = core.decode("utf-8", "replace")[:PREFIX].encode()
    a, b = zlib.crc32(core), zlib.crc32(b"^" + head)
    return a % ROWS, (a >> 16 | a << 16 & 0xFFFFFFFF) * 2654435761 % (1 << 32) % ROWS, b % ROWS, (b >> 16 | b << 16 & 0xFFFFFFFF) * 2654435761 % (1 << 32) % ROWS


class Lexicon(dict):
    """Indexes of words from 1 up, given when first met; 0 stands for the pad between texts."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, int]] = []

    def __missing__(self, word: bytes) -> int:
        self.rows.append(word_rows(word))
        self[word] = at = len(self.rows)
        return at

    def text(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    """Parameters: embedding, filters by width (width, DIM, FILTERS), biases, output weights and bias; thresholds by language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.08, (ROWS, DIM)),
            [rng.normal(0, 0.6 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS],
            [np.zeros(FILTERS) for _ in WIDTHS],
            rng.normal(0, 0.2, len(WIDTHS) * FILTERS),
            0.0,
        )

    def tables(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each width and offset the filters' responses to words given by their embedding rows; the pad's come first."""
        e = np.zeros((len(rows) + 1, DIM))
        for j in range(rows.shape[1] if len(rows) else 0):
            e[1:] += self.embedding[rows[:, j]]
        return [(e @ f[o]).astype(np.float32) for f in self.filters for o in range(len(f))]


def responses(index: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each width the responses of its filters to the windows that begin at each word."""
    out, slot = [], 0
    for width in WIDTHS:
        total = tables[slot].take(index, axis=0)
        for o in range(1, width):
            total[: len(index) - o] += tables[slot + o].take(index[o:], axis=0)
        out.append(total)
        slot += width
    return out


def probability(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one stream, pads after each, and where each begins; texts must not be empty."""
    gap = np.zeros(max(WIDTHS) - 1, np.int64)
    starts = np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])
    return np.concatenate([x for t in texts for x in (t, gap)]), starts


def forward(model: Model, texts: list[np.ndarray], tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden units, where each has its maximum, logits) for each text; texts without words have the bias alone."""
    units = len(WIDTHS) * FILTERS
    hidden, where = np.zeros((len(texts), units)), np.zeros((len(texts), units), np.int64)
    some = [i for i, t in enumerate(texts) if len(t)]
    if some:
        stream, starts = padded([texts[i] for i in some])
        for w, total in enumerate(responses(stream, tables)):
            own = slice(w * FILTERS, (w + 1) * FILTERS)
            for i, s in zip(some, starts.tolist(), strict=True):
                part = total[s : s + len(texts[i])]
                at = part.argmax(axis=0)
                where[i, own] = at
                hidden[i, own] = np.maximum(0, part[at, range(FILTERS)] + model.bias[w])
    return hidden, where, hidden @ model.out + model.out_bias


def train(texts: list[bytes], labels: np.ndarray, langs: list[str | None], seed: int = 11) -> Model:
    """Adagrad over small blocks in random order; a fifth of the sample is kept apart for the calibration."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    if len(texts) == 0 or labels.min() == labels.max():
        model.out[:] = 0
        model.out_bias = -4.0 if len(texts) == 0 or labels.max() == 0 else 4.0
        return model
    lexicon = Lexicon()
    index = [lexicon.text(t) for t in texts]
    rows = np.array(lexicon.rows, np.int32).reshape(-1, 4)
    del lexicon
    # rows that hardly any text uses stay at zero: they could only learn single texts by heart
    spread = np.zeros(ROWS, np.int64)
    for i in index:
        if len(i):
            spread[np.unique(rows[np.unique(i) - 1])] += 1
    known = spread >= MIN_TEXTS
    model.embedding[~known] = 0
    part = rng.random(len(texts))
    fit, held = np.flatnonzero(part >= 0.2), np.flatnonzero(part < 0.2)
    params = [model.embedding, *model.filters, *model.bias, model.out]
    squares = [np.full(x.shape, 1e-3) for x in params]
    bias_square = 1e-3
    clean = fit[labels[fit] == 0]
    weight = np.array([0.5 / max(1e-9, (labels[fit] == c).mean()) for c in (0, 1)])
    slots = np.cumsum([0, *WIDTHS])
    done = 0
    while done < UPDATES:
        for block in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            done += 1
            batch = [index[i] for i in block]
            for i in rng.choice(clean, CUTS) if len(clean) else ():
                begin = int(rng.integers(0, len(index[i]) + 1))
                batch.append(index[i][begin : begin + int(rng.integers(0, CUT_WORDS))])
            truth = np.concatenate([labels[block], np.zeros(len(batch) - len(block), np.int64)])
            used = np.unique(np.concatenate(batch))
            used = used[used > 0]
            tables = model.tables(rows[used - 1])
            own = [np.searchsorted(used, t) + 1 for t in batch]
            hidden, where, z = forward(model, own, tables)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth) * weight[truth] / len(batch)
            unit_error = error[:, None] * model.out[None, :] * (hidden > 0)
            grads = [None, *(np.zeros_like(f) for f in model.filters), *(unit_error[:, w * FILTERS : (w + 1) * FILTERS].sum(axis=0) for w in range(len(WIDTHS))), error @ hidden]
            word_at, word_step = [], []
            for w, width in enumerate(WIDTHS):
                for o in range(width):
                    for n, words in enumerate(batch):
                        g = unit_error[n, w * FILTERS : (w + 1) * FILTERS]
                        at = where[n, w * FILTERS : (w + 1) * FILTERS] + o
                        live = np.flatnonzero((g != 0) & (at < len(words)))
                        if len(live):
                            hit = rows[words[at[live]] - 1]
                            grads[1 + w][o][:, live] += (model.embedding[hit].sum(axis=1) * g[live, None]).T
                            word_at.append(hit)
                            word_step.append(model.filters[w][o][:, live].T * g[live, None])
            if word_at:
                at = np.concatenate(word_at)
                step = np.repeat(np.concatenate(word_step), 4, axis=0)
                step = step[known[at.ravel()]]
                touched, inverse = np.unique(at.ravel()[known[at.ravel()]], return_inverse=True)
                g = np.zeros((len(touched), DIM))
                np.add.at(g, inverse, step)
                squares[0][touched] += g * g
                model.embedding[touched] -= RATE * g / np.sqrt(squares[0][touched])
            for k in range(1, len(params)):
                g = grads[k] + DECAY * params[k]
                squares[k] += g * g
                params[k] -= RATE * g / np.sqrt(squares[k])
            bias_square += error.sum() ** 2
            model.out_bias -= RATE * error.sum() / np.sqrt(bias_square)
    tables = model.tables(rows)
    # the held texts, and a clean one without words
    held_texts, held_labels = [*(index[i] for i in held), np.zeros(0, np.int64)], np.append(labels[held], 0)
    z = np.concatenate([forward(model, held_texts[k : k + 64], tables)[2] for k in range(0, len(held_texts), 64)])
    calibrate(model, z, held_labels, [*(langs[i] for i in held), None])
    return model


def calibrate(model: Model, z: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Centres the logits of the held part, then sets each language's threshold where errors are fewest."""

    def cut(z: np.ndarray, y: np.ndarray) -> float:
        """The middle of the range with the fewest errors."""
        points = np.unique(np.concatenate([[z.min() - 1], (np.sort(z)[1:] + np.sort(z)[:-1]) / 2, [z.max() + 1]]))
        errors = np.array([((z >= p) != (y == 1)).sum() for p in points])
        best = points[errors == errors.min()]
        return float((best[0] + best[-1]) / 2)

    if len(z) and labels.min() != labels.max():
        model.out_bias -= (middle := cut(z, labels))
        z = z - middle
        for lang in {x for x in langs if x}:
            own = np.array([x == lang for x in langs])
            y = labels[own]
            model.thresholds[lang] = probability(cut(z[own], y)) if len(y) >= 20 and y.min() != y.max() else 0.5


class Scorer:
    """Scores texts with one row of responses for each word met, in a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.lexicon = Lexicon()
        self.tables = [np.zeros((1, FILTERS), np.float32) for _ in range(sum(WIDTHS))]
        self.filled = 1

    def grow(self) -> None:
        """Adds the responses of words met since the last time; room doubles."""
        known = len(self.lexicon.rows) + 1
        if known > len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros((known, FILTERS), np.float32)]) for t in self.tables]
        fresh = self.model.tables(np.array(self.lexicon.rows[self.filled - 1 :], np.int64).reshape(-1, 4))
        for t, f in zip(self.tables, fresh, strict=True):
            t[self.filled : known] = f[1:]
        self.filled = known

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(self.lexicon.rows) > MEMO:
            self.reset()
        index = [self.lexicon.text(t) for t in texts]
        self.grow()
        z = forward(self.model, index, self.tables)[2]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fold_of(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id is the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, text, lang, y) of at most per_class labelled documents of each class outside the held-out fold, those of the smallest hash of doc_id.

    A document labelled both 0 and 1 counts as 1. Of rows that share an id one is taken, that with the least text, then language (nulls first).
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # 2 * per_class ids
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang", "y")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """The classifier for docs (doc_id, text, lang) and labels (doc_id, toxic). Labels other than 0 and 1 don't count.

    The sample is bounded in rows, and in bytes: in the order of the ids' hashes, texts that would take it over most_bytes are left out
    of training (they are scored whole like any other). So one task trains on it, and only the model comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i, t, lang, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "y")), strict=True):
                text = (t or "").encode()
                if size + len(text) <= most_bytes:
                    size += len(text)
                    rows.append((i, text, lang or "", y))
        rows.sort()
        model = train([t for _, t, _, _ in rows], np.array([y for *_, y in rows], np.int64), [lang or None for _, _, lang, _ in rows])
        model.embedding = model.embedding.astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    sample = training_sample(docs, labels, per_class).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, np.int64), [])


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs' columns, then score (0 to 1) and toxic (score at or over the language's threshold, 0.5 if it has none).

    Null and empty texts get the network's answer to no words. A map over the scan; every column passes
    through, but columns named score or toxic are replaced.
    """
    docs = docs.drop("score", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        limits = shared.value.thresholds
        for batch in batches:
            for part, texts in slices(batch, text_col, 1 << 20):
                scores = scorer.score(texts).tolist()
                langs = part.column(lang_col).to_pylist()
                flags = [s >= limits.get(lang, 0.5) for s, lang in zip(scores, langs, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=[*part.schema.names, "score", "toxic"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("toxic", BooleanType())]))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns: a map over the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in slices(batch, text_col, 1 << 20):
                yield part.filter(pa.array(scorer.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


QUERIES = {"op7_toxicity": op7_toxicity}
