"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from captionforge.llm import variants
from captionforge.llm.queries import QUERIES

from .helpers import docs


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute(words, factor=5):
    """{word: (n, n_near, form, form_n, root)} for {word: n}."""
    out = {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    root = lambda w: root(out[w][2]) if out[w][2] else w
    return {w: (*row, root(w)) for w, row in out.items()}


def judged(frame):
    rows = frame.collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def mutated(rng, word, letters):
    i = rng.randrange(len(word))
    kind = rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind != 1):]


def family(rng, seeds, size, letters):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(seeds)}
    while len(words) < size:
        words |= {mutated(rng, rng.choice(sorted(words)), letters)} - {""}
    return {w: rng.choice([5, 5, 5, 26, 130, 700, 4000]) for w in sorted(words)}


def frame_of(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n bigint")


@pytest.mark.parametrize("block", [2, 12, 512])
def test_pairs_and_chains_with_small_blocks(spark, block):
    rng = random.Random(block)
    words = family(rng, 6, 260, "abé") | family(rng, 20, 200, "abcdefghijklmnopqrstuvwxyzßø÷") | {"Жук": 9, "жук": 700, "жуки": 9}
    near = variants.near_words(frame_of(spark, words), block)
    want = {w: row[1] for w, row in brute(words).items() if row[1]}
    assert {r.word: r.n_near for r in near.collect()} == want
    assert judged(variants.spelling_variants(frame_of(spark, words), block=block)) == brute(words)


def test_a_block_that_cannot_be_cut_is_multiplied_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(variants, "TILE", 8)
    letters = "abcdefghijkl"
    words = {f"same{x}{y}same": 5 + i + j for i, x in enumerate(letters) for j, y in enumerate(letters)} | {f"same{x}same": 900 for x in letters}
    assert judged(variants.spelling_variants(frame_of(spark, words))) == brute(words)
    near = variants.near_words(frame_of(spark, words), 4)
    assert {r.word: r.n_near for r in near.collect()} == {w: row[1] for w, row in brute(words).items()}


def test_chains_ties_and_single_letters(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzy": 30, "zzzzyz": 30, "zzzzzz": 6, "é": 5, "è": 25, "e": 25, "ee": 4}
    assert judged(variants.spelling_variants(frame_of(spark, words))) == brute(words)
    assert brute(words)["aaaaaa"][4] == "aabbbb" and brute(words)["zzzzzz"][2] == "zzzzyz"
    with pytest.raises(ValueError):
        variants.spelling_variants(frame_of(spark, words), 1)


def test_empty_tables(spark):
    none = docs(spark, []).select("doc_id", "text")
    assert variants.spelling_variants(variants.word_counts(none)).count() == 0
    assert variants.spelling_variants(variants.word_counts(docs(spark, [None, "", "1 2 3", "few words"]))).count() == 0


def counts(texts, ids, slips):
    total = Counter()
    for key, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


@pytest.mark.parametrize("slips", [None, 3])
def test_counts(spark, slips, monkeypatch):
    monkeypatch.setattr(variants, "KEPT_WORDS", 20)
    rng = random.Random(2)
    vocabulary = ["Straße", "ÉCOLES", "écoles", "été", "naïveté", "Œuvre", "un÷deux", "it's", "longword", "LONGWORD", "Ångström", "a" * 3000, "x1yyyyyy", "données", "short"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "日本語 longword"]
    ids = [*range(40), None, None, 7]
    frame = docs(spark, texts, ids).withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    assert {r.word: r.n for r in variants.word_counts(frame, slips=slips).collect()} == counts(texts, ids, slips)


def test_query_on_repeated_and_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    words = family(rng, 30, 120, "abcdefghé")
    texts = [" ".join(rng.choices(sorted(words), weights=[words[w] for w in sorted(words)], k=80)) for _ in range(60)] * 2 + [None, ""]
    ids = [*range(60), *range(60), None, 3]
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    assert judged(QUERIES["op12_spelling_variants"](spark, str(tmp_path))) == brute(counts(texts, ids, 199))
