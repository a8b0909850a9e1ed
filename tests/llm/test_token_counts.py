import random

import public_tokenizers
import pytest

from wirelake.llm import token_counts as tc


@pytest.fixture(scope="module")
def counter():
    return tc.TokenCounter(public_tokenizers.path(tc.VOCABULARY))


def library(counter, text):
    return len(counter.library.encode(text, add_special_tokens=False).ids)


ALPHABET = [*"abcdefghijklmnopqrstuvwxyzABCZ019 '.,!?-_<>|\n\t\x85\xa0\x1c\x00​　İΣςßéÉéñ中文字日本語한국어😀👍🏽ﬁǅ½²٣", "'s", "'RE", "<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>"]


def test_equals_the_library(counter):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        assert counter.count(text) == library(counter, text), repr(text)
    for text in ("abc" * 90, "aaaa" * 200, "the" * 99, "é" * 300, "!" * 100):
        assert counter.count(text) == library(counter, text)


def test_chunks_compose(counter, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK", 7)
    monkeypatch.setattr(tc, "RUN", 3)
    monkeypatch.setattr(tc, "RUNS", 2)
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice("abc  é.'s\n中") for _ in range(rng.randint(0, 80)))
        assert counter.count(text) == library(counter, text), repr(text)


def test_state_maps(counter):
    """A run's map gives for any state what reading the run from that state does, alone and composed in any grouping."""
    rng, t = random.Random(3), counter.transducer
    t.reset()
    for _ in range(200):
        text = "".join(rng.choice(["the", "ing", "a", "er", "x", "qu"]) for _ in range(12))
        start, _ = t.run(0, text[: rng.randint(0, 6)])
        cuts = sorted(rng.sample(range(len(text)), 4))
        maps = [tc.RunMap(t, text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        whole = t.run(start, text)
        assert tc.composed(maps)(start) == tc.composed([tc.composed(maps[:2]), tc.composed(maps[2:])])(start) == tc.RunMap(t, text)(start) == whole


def test_very_long_word(counter):
    """No white space at all: runs of one piece, far longer than a run."""
    rng = random.Random(4)
    for text in ("".join(rng.choices("etaoinshr", k=100_000)), "ab" * 50_000, "é" * 20_000, "x" * 30_000 + "1" + "!?" * 9000):
        assert counter.count(text) == library(counter, text)


def test_memory_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tc, "MEMO", 50)
    text = " ".join(f"word{i}x" for i in range(500))
    assert counter.count(text) == library(counter, text) and len(counter.memo) <= 50


def test_operator(docs_of, clash, counter):
    long = "hello world " * 3000
    rows = [(1, "Hello, world!"), (2, None), (3, ""), (4, long), (4, long), (None, "x")]
    got = sorted((tuple(r) for r in tc.token_counts(clash(docs_of(rows))).collect()), key=repr)
    brute = sorted(((i, len((t or "").encode()), library(counter, t or ""), library(counter, t or "") > 2048) for i, t in rows), key=repr)
    assert got == brute
    assert tc.token_counts(docs_of([])).count() == 0
