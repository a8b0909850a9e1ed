"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary with word ends becomes a deterministic transducer over byte symbols. Its
state lists the live token starts: for each, the symbols read since, the last token before it and the
count up to it, relative to the newest position. Transitions carry the change in the number of
emitted tokens; the closing transition of a piece reads its last symbol with the word end. States and
transitions are made when first met and interned.

White space always closes a piece, so a chunk of text that ends at white space takes the start state to the start state, whatever it
holds: the counts of such chunks add up. A run of symbols within one long piece is a map from state to (state, count). Such maps are made for each
run on its own and compose associatively, in a tree. A map runs from the start state and from the state asked for side by side until both meet
in one state; from there on the counts are those of the start's run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wirelake.llm.common import table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Code points in a chunk of a long text.
CHUNK = 1 << 16
#: Symbols in a run of a long piece, and runs whose maps are made before they are composed.
RUN, RUNS = 1 << 12, 16
#: Most entries of each memo table; a full table starts anew. Longer words and pieces aren't kept.
MEMO, LONGEST = 300_000, 100
#: What Python's str.split takes for white space and the vocabulary's pattern doesn't; texts with such characters are cut at the pattern's white space.
PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(f"[{SPACES}]+")
#: Pieces between white space, as the vocabulary file's pattern cuts them.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
#: The same for ASCII text in lower case.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Transducer:
    """Counts the BPE tokens of a piece. Symbols are one-character strings; the last one gets the word end."""

    def __init__(self, merges: Iterable[tuple[str, str]], symbols: Iterable[str], end: str):
        self.end = end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = set(symbols) | {s + end for s in symbols} | {a + b for a, b in self.rank}
        # the proper prefixes of tokens, in symbols
        self.prefixes = {""}
        for t in self.tokens:
            body = t[: -len(end)] if t.endswith(end) and len(t) > len(end) else t
            self.prefixes.update(body[:i] for i in range(1, len(body)))
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the first. A state is a tuple of (symbols since a start, token before it, count up to it)."""
        start = (("", "", 0),)
        self.states, self.known = [start], {start: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.closes: dict[tuple[int, str], int] = {}

    def split(self, text: str) -> list[str]:
        """The merges themselves, for short texts: the definition that the transducer is compiled from."""
        ended = text.endswith(self.end) and len(text) > len(self.end)
        body = text[: -len(self.end)] if ended else text
        parts = [*body[:-1], body[-1] + self.end * ended]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, before: str, token: str) -> bool:
        """May the token stand after the other in an encoding? Encodings are the chains whose neighbours may."""
        if token not in self.whole:
            self.whole[token] = self.split(token) == [token]
        if not self.whole[token]:
            return False
        if not before:
            return True
        if (before, token) not in self.pairs:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            self.pairs[before, token] = self.split(before + token) == [before, token]
        return self.pairs[before, token]

    def last(self, state: int, symbol: str) -> tuple[str, int]:
        """The encoding's last token after one more symbol, and the change in the count."""
        for since, before, count in self.states[state]:
            token = since + symbol
            if token in self.tokens and self.follows(before, token):
                return token, count + 1
        raise ValueError(f"no token ends at {symbol!r}")

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        token, emitted = self.last(state, symbol)
        live = [(since + symbol, before, count - emitted) for since, before, count in self.states[state] if since + symbol in self.prefixes]
        to = self.intern((*live, ("", token, 0)))
        self.moves[state, symbol] = to, emitted
        return to, emitted

    def intern(self, content: tuple) -> int:
        state = self.known.get(content)
        if state is None:
            state = self.known[content] = len(self.states)
            self.states.append(content)
        return state

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        """(state, count) after the symbols."""
        total = 0
        for symbol in symbols:
            state, emitted = self.moves.get((state, symbol)) or self.move(state, symbol)
            total += emitted
        return state, total

    def count(self, piece: str) -> int:
        if len(self.moves) + len(self.closes) > MEMO:
            self.reset()
        state, total = (0, 0) if len(piece) <= RUN else (None, 0)
        if state is None:
            content = self.states[0]
            for at in range(0, len(piece) - 1, RUN * RUNS):
                if len(self.moves) > MEMO:
                    self.reset()
                part = piece[at : min(at + RUN * RUNS, len(piece) - 1)]
                whole = composed([RunMap(self, part[i : i + RUN]) for i in range(0, len(part), RUN)])
                state, emitted = whole(self.intern(content))
                content, total = self.states[state], total + emitted
        else:
            state, total = self.run(0, piece[:-1])
        key = state, piece[-1]
        if key not in self.closes:
            self.closes[key] = self.last(state, piece[-1] + self.end)[1]
        return total + self.closes[key]


StateMap = Callable[[int], tuple[int, int]]


class RunMap:
    """What a run of symbols does to any state: state to (state, count)."""

    def __init__(self, transducer: Transducer, symbols: str):
        self.transducer, self.symbols = transducer, symbols
        self.path, self.counts = [0], [0]  # from the start state: the state and the count before each symbol, and at the end
        for symbol in symbols:
            state, emitted = transducer.moves.get((self.path[-1], symbol)) or transducer.move(self.path[-1], symbol)
            self.path.append(state)
            self.counts.append(self.counts[-1] + emitted)

    def __call__(self, state: int) -> tuple[int, int]:
        total = 0
        for i, symbol in enumerate(self.symbols):
            if state == self.path[i]:
                return self.path[-1], total + self.counts[-1] - self.counts[i]
            state, emitted = self.transducer.moves.get((state, symbol)) or self.transducer.move(state, symbol)
            total += emitted
        return state, total


def composed(maps: list[StateMap]) -> StateMap:
    """One map for maps in turn: neighbours are joined until one is left."""

    def both(a: StateMap, b: StateMap) -> StateMap:
        def run(state: int) -> tuple[int, int]:
            middle, first = a(state)
            end, second = b(middle)
            return end, first + second

        return run

    while len(maps) > 1:
        maps = [both(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class TokenCounter:
    """Counts tokens of whole texts as the vocabulary's own library does, special strings included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.symbol = byte_symbols()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(merges, self.symbol.values(), model["end_of_word_suffix"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = [t[0] for t in special]
        self.memo: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def word(self, raw: str) -> int:
        """Tokens of a run without white space, which normalisation and pieces don't cross."""
        count = 0
        if raw.isascii():
            low = raw.lower()
            pieces = (low,) if low.isalpha() else ASCII_PIECES.findall(low)
        else:
            pieces = PIECES.findall(self.library.normalizer.normalize_str(raw))
        for piece in pieces:
            n = self.pieces.get(piece)
            if n is None:
                plain = piece.isascii() and piece.isprintable()
                n = self.transducer.count(piece if plain else "".join(map(self.symbol.__getitem__, piece.encode())))
                if len(piece) <= LONGEST:
                    if len(self.pieces) >= MEMO:
                        self.pieces.clear()
                    self.pieces[piece] = n
            count += n
        if len(raw) <= LONGEST:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[raw] = count
        return count

    def words(self, words: list[str]) -> int:
        memo = self.memo
        total = 0
        for w in words:
            n = memo.get(w)
            total += self.word(w) if n is None else n
        return total

    def plain(self, text: str) -> int:
        """A text without special strings, in chunks that end at white space."""
        cut = SPACE.split if PYTHON_ONLY_SPACE.search(text) else str.split
        total = at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK and (space := SPACE.search(text, at + CHUNK)):
                end = space.start()
            total += self.words([w for w in cut(text[at:end]) if w])
            at = end
        return total

    def count(self, text: str) -> int:
        if self.special is None or not any(m in text for m in self.marks) or not self.special.search(text):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(self.plain(part) for part in self.special.split(text))


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> TokenCounter:
    """One compiled counter for each Python worker."""
    import public_tokenizers

    return TokenCounter(public_tokenizers.path(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; texts and words of any length are read whole. Ids are carried as they are, repeated or null;
    other columns are ignored; an empty table gives an empty result.
    A map over the scan: no shuffle, and memory for one batch of texts and the bounded memo tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_counts": op3_token_counts}
