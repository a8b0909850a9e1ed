"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that reveal them.

An entity is a kind with its value, or a kind by itself, which pools all its values: most values stand in one
text only. For each entity e and each term t of a document that has it, the
disclosure of t is PMI(e; t) / IC(e), where PMI = log2 p(e, t) / (p(e) p(t)) and IC = -log2 p(e) over
documents: 1 says that t never occurs without e. Terms at or over `remove_at` are to be removed, terms at or
over `generalise_at` to be replaced by their class, wherever in the corpus they stand, provided that at least
`min_support` documents show the pair (for a kind by itself, so many different texts, so that copies of one don't).

Four scans: documents of each entity; (entity, term) pairs of the kinds and of entities with support; document frequencies of just those terms, which a
bitmap of fixed size singles out; the spans and the sanitised text. The disclosing terms are broadcast as 64-bit hashes, in as many parts
as their number asks for, each part a pass over the rows that the last one left. No text is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirelake.llm.common import collect_bitmap, stage, table

# The patterns of the four kinds, in the order in which spans are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

DIGIT = re.compile("[0-9]")
TERM = re.compile(r"\w+(?:['-]\w+)*")
MIN_SUPPORT = 3
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Disclosing terms that are broadcast at once: 9 bytes each.
TERMS = 1 << 21


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches hold no white space, so only runs around an @ are searched."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and not text[left - 1].isspace():
            left -= 1
        right = at
        while right < len(text) and not text[right].isspace():
            right += 1
        yield from (m.span() for m in EMAIL.finditer(text, left, right))
        done = right
        at = text.find("@", right)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind, then start. Code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The kinds of the spans, and the kinds with their folded values."""
    return {k for k, _, _ in spans} | {f"{k}:{text[a:b].lower()}" for k, a, b in spans}


def entity_counts(docs: DataFrame) -> DataFrame:
    """(entity, entity_df): the documents of each entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities: list[str] = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                entities += entities_of(text, base_spans(text))
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string())], names=["entity"])

    return docs.mapInArrow(run, "entity string").groupBy("entity").agg(F.count(F.lit(1)).alias("entity_df"))


def pairs_in_documents(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """(entity, term, key) once for each document that has both; terms outside the spans, entities in the bitmap; key stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        size = len(bits) * 8
        for batch in batches:
            entities, terms, keys = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                here = [e for e in entities_of(text, spans) if bits[(h := term_hash(e) % size) >> 3] >> (h & 7) & 1]
                if here:
                    parts, at = [], 0
                    for _, a, b in sorted(spans, key=lambda x: x[1:]):
                        parts.append(text[at:a])
                        at = max(at, b)
                    found = [t for t in term_set(" ".join([*parts, text[at:]])) if not t.isdigit()]
                    key = xxhash.xxh3_64_intdigest(text.encode()) >> 1
                    for e in here:
                        entities += [e] * len(found)
                        terms += found
                        keys += [key] * len(found)
                if len(terms) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(terms, pa.string()), pa.array(keys, pa.int64())], names=["entity", "term", "key"])
                    entities, terms, keys = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(terms, pa.string()), pa.array(keys, pa.int64())], names=["entity", "term", "key"])

    return docs.mapInArrow(run, "entity string, term string, key long")


def term_set(text: str) -> set[str]:
    """The distinct terms of a text, folded once they are cut out. Single words are found by cutting at white space, then trimmed or searched."""
    out: set[str] = set()
    for w in set(text.split()):
        if w.isalnum():
            out.add(w.lower())
        else:
            out.update(t.lower() for t in TERM.findall(w))
    return out


def term_hash(term: str) -> int:
    return zlib.crc32(term.encode())


def document_frequencies(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """(term, df) of the terms in the bitmap; terms that share a bit come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        size = len(bits) * 8
        known: dict[str, bool] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            for value in batch.column("text"):
                for t in term_set(value.as_py() or ""):
                    hit = known.get(t)
                    if hit is None:
                        spot = term_hash(t) % size
                        if len(known) > 300_000:
                            known.clear()
                        hit = known[t] = bool(bits[spot >> 3] >> (spot & 7) & 1)
                    if hit:
                        counts[t] = counts.get(t, 0) + 1
            if len(counts) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])
                counts = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

    return docs.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing_terms(docs: DataFrame, min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(term, disclosure, action): terms at or over generalise_at; action is generalise or remove.

    docs has the column text. Probabilities are over rows; copies count as often as they occur.
    """
    entities = stage(entity_counts(docs).where(F.col("entity_df") >= min_support), "pii-entities")
    asked = collect_bitmap(entities, F.crc32(F.col("entity").cast("binary")))
    texts = pairs_in_documents(docs, asked).groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("copies"))
    counted = texts.groupBy("entity", "term").agg(F.sum("copies").alias("together"), F.count(F.lit(1)).alias("texts"))
    support = F.when(F.col("entity").isin(*KINDS), F.col("texts")).otherwise(F.col("together"))
    pairs = stage(counted.where(support >= min_support), "pii-pairs")
    bits = collect_bitmap(pairs.select("term"), F.crc32(F.col("term").cast("binary")))
    total = docs.count()
    joined = pairs.join(document_frequencies(docs, bits), "term").join(entities, "entity")
    pmi = F.log2(F.col("together") * F.lit(float(total)) / (F.col("entity_df") * F.col("df").cast("double")))
    ic = -F.log2(F.col("entity_df") / F.lit(float(total)))
    best = joined.where(F.col("entity_df") < total).groupBy("term").agg(F.max(pmi / ic).alias("disclosure"))
    return best.where(F.col("disclosure") >= generalise_at).withColumn("action", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise"))


def key_of(term: str) -> int:
    """64 bits of a term's hash, as Spark's long."""
    h = xxhash.xxh3_64_intdigest(term.encode())
    return h - (1 << 64) if h >> 63 else h


class Terms:
    """Disclosing terms by their hashes, sorted, with what is to be done to each."""

    def __init__(self, keys: np.ndarray, remove: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.remove = keys[order], remove[order]
        self.known: dict[str, str | None] = {}

    def action(self, term: str) -> str | None:
        """remove, generalise or None."""
        if term in self.known:
            return self.known[term]
        if len(self.known) > 300_000:
            self.known.clear()
        key = key_of(term)
        at = int(np.searchsorted(self.keys, key))
        hit = at < len(self.keys) and self.keys[at] == key
        self.known[term] = out = ("remove" if self.remove[at] else "generalise") if hit else None
        return out

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
        """(start, end, remove) of the terms in the text that overlap none of the taken spans."""
        if not len(self.keys) or not any(self.action(t) for t in term_set(text)):
            return []
        out, k = [], 0
        taken = sorted(taken)
        for m in TERM.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not any(x < b and a < y for x, y in taken[k : k + 1]) and (action := self.action(m[0].lower())):
                out.append((a, b, action == "remove"))
        return out


def term_parts(disclosing: DataFrame) -> Iterator[Terms]:
    """The disclosing terms in parts of about TERMS each; one part, which may be empty, if they are few."""
    hashed = disclosing.mapInArrow(hash_terms, "key long, remove boolean")
    parts = max(1, -(-disclosing.count() // TERMS))
    for k in range(parts):
        own = hashed.where(F.pmod("key", F.lit(parts)) == k) if parts > 1 else hashed
        found = own.toArrow()
        yield Terms(found.column("key").to_numpy(), found.column("remove").to_numpy())


def hash_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [key_of(t) for t in batch.column("term").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([a == "remove" for a in batch.column("action").to_pylist()], pa.bool_())], names=["key", "remove"])


FOUND = [*(f"n_{k}" for k in KINDS), "base", "terms", "sanitised"]
SPOTS = "array<struct<start:int,end:int,remove:boolean>>"


def find_pii(docs: DataFrame, disclosing: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns, then n_email, n_ip, n_card, n_phone, base, terms, sanitised: one row for each row of docs.

    base is the joined base spans; terms is an array of (start, end, remove), none of which overlaps a base span; sanitised is the
    text with base spans replaced by their kind, terms removed or replaced by their class (null stays null). Each row's spans and text
    are found together, so repeated and null ids can't mix texts up. Null and empty texts have no spans; texts of any length
    are read whole. Columns of docs that bear an added name are replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in FOUND]
    docs = docs.select(*kept)
    spot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]))
    counts = "".join(f", n_{k} long" for k in KINDS)
    added = StructType.fromDDL(f"base string, terms {SPOTS}, sanitised string{counts}")
    schema = StructType([*docs.schema.fields, *(added[c] for c in FOUND)])
    out = None
    parts = list(term_parts(disclosing))
    for k, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0, last=k + 1 == len(parts)) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    rows = batch.slice(lo, 256)
                    found: dict[str, list] = {c: [] for c in FOUND}
                    for n, value in enumerate(rows.column(text_col)):
                        text = value.as_py() or ""
                        spans = base_spans(text)
                        for kind in KINDS:
                            found[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                        before = [] if first else [tuple(x.values()) for x in rows.column("terms")[n].as_py()]
                        terms = sorted([*before, *known.spans(text, [(a, b) for _, a, b in spans])])
                        found["base"].append(listed(spans))
                        found["terms"].append([{"start": a, "end": b, "remove": r} for a, b, r in terms])
                        found["sanitised"].append(redact(text, spans, terms) if last and value.is_valid else None)
                    types = [pa.int64()] * len(KINDS) + [pa.string(), spot, pa.string()]
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(found[c], t) for c, t in zip(FOUND, types, strict=True))], names=[*kept, *FOUND])

        out = (docs if out is None else out).mapInArrow(run, schema)
    return out


def redact(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with base spans replaced by their kind, terms generalised to their class or removed."""
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
    for a, b, remove in terms:
        word = text[a:b]
        shape = "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[0].isupper() else "[WORD]"
        marks.append((a, b, "" if remove else shape))
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:  # kinds may overlap; the first one's mark stands
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column sanitised: the text after generalising and removing. Nulls stay null; see find_pii for odd rows."""
    terms = stage(disclosing_terms(docs.select(F.col(text_col).alias("text"))), "pii-terms")
    kept = [c for c in docs.columns if c != "sanitised"]
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*kept).alias("doc"))
    return find_pii(packed, terms).select("doc.*", "sanitised")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term spans follow the base spans, as term:start:end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, stage(disclosing_terms(docs), "pii-terms"))
    extra = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"]))
    both = F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), extra), ",")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), both.alias("spans"), F.size("terms").cast("long").alias("n_terms"), "sanitised")


QUERIES = {"op1_pii": op1_pii}
