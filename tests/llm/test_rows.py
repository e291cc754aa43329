"""Licences, quality rules, token counts and the classifier: operators that look at one row."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from captionforge.llm import licenses, quality, rules, tokens

from .helpers import docs, prose

MIT = """Copyright (c) 2020 Someone

{grant}

{condition}

{warranty}""".format(**{k: licenses.SENTENCES[f"mit-{k}"][0].replace(" of ", " of\n") for k in ("grant", "condition", "warranty")})


def test_licences(spark):
    cases = [
        (MIT, ["MIT"]), ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]), ("text. Released under the MIT License!\nmore", ["MIT"]),
        ("Licensed under CC BY 4.0. And. Released under the MIT License.", ["CC-BY-4.0", "MIT"]), ("Mit. Permission", []), (None, []), ("", []),
        ("released under the mit license but not", []), ("x " * 50_000 + ". Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public\nLicense as published by "
         "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
        # out of order, and with too much between
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
         + licenses.SENTENCES["mit-grant"][0], []),
    ]
    frame = docs(spark, [t for t, _ in cases]).withColumn("licences", F.lit("clash"))
    found = licenses.scan(frame).orderBy("doc_id").collect()
    assert [list(r.licences.licences) for r in found] == [want for _, want in cases]
    assert "mit-grant" in found[-1].licences.loose
    assert licenses.scan(frame.limit(0)).count() == 0


def test_licence_table_can_be_found():
    known = licenses.known_sentences()
    assert set(known.values()) == set(licenses.SENTENCES) and {i for _, ids in licenses.RULES for i in ids} <= set(known.values())
    import re
    starts = {ids[0] for _, ids in licenses.RULES}
    assert all(re.search(licenses.HINT, s) for name in starts for s in licenses.SENTENCES[name])


def test_each_known_sentence_alone(spark, monkeypatch):
    cases = [(name, s) for name, every in licenses.SENTENCES.items() for s in every]
    texts = [way(s) for _, s in cases for way in (str, str.upper, lambda s: s.replace(" ", "\n"), lambda s: s.replace(" ", "  "))]
    scan = lambda: [r.licences for r in licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    found = scan()
    monkeypatch.setattr(licenses, "HINT", "")
    assert found == scan()
    taken = {ids[0] for _, ids in licenses.RULES if len(ids) == 1}
    for (name, _), rows in zip(cases, [found[i:i + 4] for i in range(0, len(found), 4)]):
        if not name.startswith("="):
            assert all(r.licences if name in taken else name in r.loose for r in rows), name


def repeated(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({k for p in places.values() if len(p) > 1 for i in p for k in (i, i + 1, i + 2)})


def test_rule_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b c a b c", "a a a a", "a a a", "x\ny\nx\n\n\nx ", "#$ %&| <> *", " nbsp", "la " * 5000]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(300)]
    w = F.col(rules.WORDS)
    rows = rules.with_words(docs(spark, texts)).select(
        "doc_id", rules.n_repeat_words(rules.windows(w)).alias("r"), rules.n_dup_lines(rules.body()).alias("d"), rules.n_words(w).alias("n"),
        rules.n_symbols(rules.body()).alias("s"), rules.word_chars(w).alias("c")).orderBy("doc_id").collect()
    assert [r.r for r in rows] == [repeated(t) for t in texts]
    for r, text in zip(rows, texts):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert r.d == len(lines) - len(set(lines)) and r.s == sum(c in "#*$%&|<>" for c in text or "")
        assert r.c == sum(c not in " \t\n\x0b\x0c\r" for c in text or "")


def test_cascade_order_and_verdict(spark):
    frame = docs(spark, ["good plain words here " * 20] * 30 + ["SHOUT LOUD " * 30] * 10 + [None, ""])
    measured = rules.measure(frame, rules.default_rules())
    order = rules.ordered(measured)
    rate = {m[0].name: m[2] / max(m[1], 1e-6) for m in measured}
    assert [rate[r.name] for r in order] == sorted(rate.values(), reverse=True)
    kept = rules.keep_good(frame)
    assert kept.columns == frame.columns
    shuffled = rules.with_words(frame).where(rules.first_rejection(rules.default_rules()[::-1]).isNull())
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in shuffled.collect()} == {*range(30), 40, 41}
    assert rules.keep_good(frame.limit(0)).count() == 0


def brute_lines(text, rule, coder):
    raw = text.encode()
    line = np.cumsum(np.append(0, [c == 10 for c in raw]))[:-1] if raw else np.zeros(0, int)
    out, crossing, at = np.zeros(text[:-1].count("\n") + 1 if text else 1), 0, 0
    for end in coder.ends(text):
        own = line[at:end]
        crossing += own[0] != own[-1]
        if rule == "start":
            out[own[0]] += 1
        elif rule == "majority":
            out[np.bincount(own).argmax()] += 1
        else:
            np.add.at(out, own, 1 / len(own))
        at = end
    return out, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts(spark, rule):
    rng = random.Random(5)
    texts = ["", None, "\n\n\n", "a\nb\n", "x", "\n\n  \n\n\tif x:\n\n\n", "é\n\n中文\r\n\r\n", "w" * 5000]
    texts += ["".join(rng.choices("ab \n\né.", k=rng.randint(1, 60))) for _ in range(150)]
    frame = docs(spark, texts)
    coder = tokens.ByteTokens(tokens.tokenizer_path())
    for r in frame.withColumn("score", tokens.count_tokens(rule=rule)).collect():
        want, crossing = brute_lines(r.text or "", rule, coder)
        got = [s.tokens for s in r.score.sections]
        assert np.allclose(got, want) and r.score.n_crossing == crossing and np.isclose(sum(got), r.score.n_tokens)


def test_token_fields(spark):
    frame = spark.createDataFrame([("a b", "c d e", None), ("", "x", "y"), (None, None, None)], "title string, body string, tokens string")
    rows = tokens.count_fields(frame, ["title", "body", "tokens"], rule="start").collect()
    assert [tuple(r.tokens) for r in rows][1][1] >= 1 and rows[0].tokens.title >= 2
    with pytest.raises(ValueError):
        tokens.count_tokens(rule="nearest")


def labelled(spark, n=240):
    rng = random.Random(9)
    texts, quality_of = [], []
    for i in range(n):
        good = i % 3 > 0
        text = prose(rng, rng.randint(3, 160))
        texts.append(text if good else " ".join(w + "###" for w in text.split()))
        quality_of.append((i, int(good)))
    return docs(spark, texts), spark.createDataFrame(quality_of, "doc_id long, quality int"), dict(quality_of)


def test_classifier_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 150)
    frame, labels, truth = labelled(spark)
    model = quality.train(frame, labels)
    rows = quality.with_score(frame, model).withColumn("held", quality.held_out()).collect()
    assert {r.doc_id for r in rows if r.held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(r.score >= quality.CUT) == truth[r.doc_id] for r in rows if r.held]
    assert np.mean(right) > 0.9
    # the same text has the same score wherever it stands, and odd texts have one
    odd = quality.with_score(docs(spark, [None, "", "x", rows[0].text, "a" * 200_000], [None, 1, 1, 2, 3]), model, out="score").collect()
    assert all(0 <= r.score <= 1 for r in odd) and odd[3].score == pytest.approx(rows[0].score, abs=1e-5)
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns


def test_classifier_without_labels(spark):
    frame, labels, _ = labelled(spark, 12)
    scored = quality.with_score(frame, quality.train(frame, labels.limit(0))).collect()
    assert {r.score for r in scored} == {0.5}
    assert {r.score for r in quality.with_score(frame, quality.train(frame, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.with_score(frame.limit(0), quality.train(frame.limit(0), labels)).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    texts, labels = [b"abc def " * 20, b"###" * 50, b""], np.array([1, 0, 1], np.float32)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "STEPS", 3)
        model = {k: v.astype(np.float64) for k, v in quality.fit(texts, labels.astype(int), steps=3).items()}

    def loss(m):
        p = quality.score_texts(m, pa.array([t.decode() for t in texts]))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality._gradients(model, texts, labels)
    for name in ("head", "w1", "w2", "pool", "bias", "embed"):
        flat = grads[name].ravel()
        for i in (rng.integers(0, flat.size, 3) if name != "embed" else [int(np.abs(flat).argmax())]):
            up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
            up[name].ravel()[i] += 1e-5
            down[name].ravel()[i] -= 1e-5
            assert flat[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=1e-5)


def test_chunks_cover_every_byte():
    for size in (0, 1, 8, 511, 512, 513, 1016, 1017, 5000):
        starts, rows = quality.chunk_table(np.array([size]))
        covered = {(s + k, s + k + 8) for s in starts for k in range(0, quality.CHUNK - 7, 4)}
        assert all((k, k + 8) in covered for k in range(0, max(0, size - 7), 4))
