"""Runs of repeated words against brute force, and the grammar's answers against plain comparison."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.llm import periodic
from captionforge.llm.queries import QUERIES

from .helpers import docs


def brute(words, least=12):
    """{(start, length): smallest period}, every period and every stretch looked at."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng):
    kinds, n = rng.choice([1, 2, 3, 30]), rng.randint(0, 120)
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def as_sequence(texts):
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size + 1) - size
    words = np.zeros((size + 1).sum() + 1, np.int64)
    for at, text in zip(begin, texts):
        words[at:at + len(text)] = [int(w[1:]) for w in text]
    words[np.append(0, begin + size)] = 1000 + np.arange(len(size) + 1)
    return words, begin, size


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_groups_of_texts(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
        words, begin, size = as_sequence(texts)
        found = [tuple(r) for r in periodic.runs_of_texts(words, begin, size, least)]
        assert found == [(b + s, n, q) for b, t in zip(begin, texts) for s, n, q in brute(t, least)]


def test_small_blocks_of_candidates(monkeypatch):
    monkeypatch.setattr(periodic, "CANDIDATES", 7)
    rng = random.Random(3)
    texts = [periodic_words(rng) for _ in range(12)]
    words, begin, size = as_sequence(texts)
    found = [tuple(r) for r in periodic.runs_of_texts(words, begin, size)]
    assert found == [(b + s, n, q) for b, t in zip(begin, texts) for s, n, q in brute(t)]


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_extensions_of_the_grammar_in_both_directions(kinds):
    rng = np.random.default_rng(kinds)
    for n in (1, 2, 9, 64, 700):
        body = rng.integers(0, kinds, n)
        body[n // 2:] = body[:n - n // 2]  # far places agree for long
        words = np.concatenate([[kinds], body, [kinds + 1]])
        ends = np.zeros(n + 2, dtype=bool)
        ends[[0, -1]] = True
        levels, top = periodic.recompress(words, ends)
        assert len(top) <= periodic.FEW + 2
        p, q = rng.integers(1, n + 1, 200), rng.integers(1, n + 1, 200)
        p, q = p[p != q], q[p != q]
        ahead = periodic.common_extension(levels, top, p, q)
        back = periodic.common_extension([x.mirrored() for x in levels], top[::-1], n + 1 - p, n + 1 - q)
        for i, j, a, b in zip(p, q, ahead, back):
            want = next(k for k in range(n + 2) if words[i + k] != words[j + k])
            assert a == want
            assert b == next(k for k in range(n + 2) if words[i - k] != words[j - k])


def test_texts(spark):
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "a", "x " * 40, "a b " * 6, "a b " * 5, "\x0bé\x0c" * 12, "a b " * 12, " ".join(["k"] * 20_000)]
    texts += ["  ".join(periodic_words(rng)) for _ in range(40)]
    texts += texts[10:14]
    ids = [None, *range(len(texts) - 5), 1, 1, 2, 3]
    frame = docs(spark, texts, ids).withColumns({"found": F.lit(1), "runs": F.lit("clash"), "at": F.monotonically_increasing_id()})
    rows = sorted(periodic.with_runs(frame).collect(), key=lambda r: r.at)
    assert [r.text for r in rows] == texts and [r.doc_id for r in rows] == ids and {r.runs for r in rows} == {"clash"}
    for text, r in zip(texts, rows):
        words = [w.decode() for w in (text or "").encode().split()]
        want = [(0, len(words), 1)] if len(words) > 10_000 else brute(words)
        assert [tuple(x) for x in r.found.runs] == want and r.found.n_words == len(words)
        assert r.found.collapsed == collapse(words, want)
    assert periodic.with_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(min_length=1)


def test_query_on_odd_rows(spark, tmp_path):
    # ids with crc32 divisible by ten and no words must not divide by zero
    ids = list(range(60)) + [None]
    docs(spark, [None, "", "a b c", "a " * 30, "one two three four five six"][:5] * 12 + ["z " * 15], ids).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_word_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == 61 and all((r.n_runs == 0) == (r.start is None) for r in rows)
    assert all(r.n_runs == 1 and (r.start, r.length, r.period, r.exponent_milli) == (0, 30, 1, 30000) for r in rows if r.doc_id is not None and r.doc_id % 5 == 3)
