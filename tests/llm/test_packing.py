import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from captionforge.llm import packing as P
from captionforge.llm.queries import op5_pack

from .helpers import docs, prose


def check(spark, texts, ids=None, sequence=256, grid=8):
    coder = Tokenizer.from_file(P.tokenizer_path())
    rows = P.pack(docs(spark, texts, ids), sequence=sequence, grid=grid).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    if ids is None:
        for i, text in enumerate(texts):
            want = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            got = sorted(pieces[i], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in got) == want.tobytes()
            assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
            assert {r.doc_tokens for r in got} == {len(want)}
    padding = total = 0
    for rows_of in sequences.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= sequence
        total += at
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return rows, padding / max(1, total + padding)


def test_every_id_once_and_little_padding(spark):
    rng = random.Random(1)
    texts = [prose(rng, int(rng.gammavariate(1.2, 60)) + 1) for _ in range(600)] + [None, "", " ", prose(rng, 5000)]
    _, padding = check(spark, texts)
    assert padding < 0.04


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows, _ = check(spark, ["a b c"] * 30 + ["x"], [None] * 15 + [4] * 15 + [9])
    assert len(rows) >= 31 and sum(r.length for r in rows) == 30 * 4 + 2
    assert P.pack(docs(spark, ["x"]).limit(0)).count() == 0


def test_digests_meet_in_sequences_without_their_ids(spark, tmp_path):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(200)] + [None, prose(rng, 900)]
    frame = docs(spark, texts)
    rows = P.pack(frame, sequence=256).collect()
    digests = P.pack(frame, sequence=256, of=F.crc32)
    assert sorted(tuple(r) for r in digests.collect()) == sorted((*r[:-1], zlib.crc32(r.ids)) for r in rows)
    # the query digests the ids below the window over a sequence
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    plan = op5_pack(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Window" in line and "sequence_id" in line)
    assert "crc32" in plan[at + 1]
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_encoder_is_the_tokenizer():
    rng = random.Random(2)
    parts = ["a", "B", "é", "É", "́", "'", "s", "'s", "ll", "!", "<|endoftext|>", "<|", "|>", " ", "\n", "\t", " ", "\x0b", "\x85", "22", ",", ".",
             "İ", "ß", "中", "…", "\x1c", "_", "👍"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + [None, "w" * 3000]
    coder, own = Tokenizer.from_file(P.tokenizer_path()), P.WordEncoder(P.tokenizer_path())
    got = [ids.tolist() for _, some in own.encode(pa.array(texts, pa.string())) for ids in some]
    assert got == [coder.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_starts_its_table_anew(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 40)
    monkeypatch.setattr(P, "GROUP_BYTES", 200)
    rng = random.Random(3)
    texts = [prose(rng, 12) for _ in range(60)]
    coder, own = Tokenizer.from_file(P.tokenizer_path()), P.WordEncoder(P.tokenizer_path())
    got = [ids.tolist() for _, some in own.encode(pa.array(texts)) for ids in some]
    assert got == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_short_texts_leave_no_padding(spark):
    """Ten thousand ids in texts of no word or one, of which every length would round up to eight."""
    rng = random.Random(6)
    texts = [rng.choice([None, "", "a", "b", "the", "word"]) for _ in range(6000)]
    rows, padding = check(spark, texts, sequence=2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 1 and padding < 0.2
    mixed = texts + [prose(rng, rng.randint(5, 300)) for _ in range(400)]
    rows, padding = check(spark, mixed, sequence=2048)
    assert padding < 0.03


def test_many_special_strings_in_one_text():
    text = "<|endoftext|> a " * 3000
    coder, own = Tokenizer.from_file(P.tokenizer_path()), P.WordEncoder(P.tokenizer_path())
    calls = []
    encode = own.tokenizer.encode
    own.tokenizer = type("Counting", (), {"encode": staticmethod(lambda t, **k: calls.append(t) or encode(t, **k))})
    (_, (plain, special)), = own.encode(pa.array(["b c", text]))
    assert special.tolist() == coder.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 2  # new words, and the text once
    assert plain.tolist() == coder.encode("b c", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_linear_program_reaches_its_bound(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 200, 32)
    patterns, used = P.solve(demand, 32, gap=0)
    assert (patterns @ np.arange(1, 33) <= 32).all()
    kinds = np.flatnonzero(demand)
    assert np.allclose((patterns.T @ used)[kinds], demand[kinds])
    assert used.sum() >= demand @ np.arange(1, 33) / 32 - 1e-6
    rows, placed, filled = P.place_table(demand, 256, 8)
    assert (placed <= demand).all() and (demand - placed).sum() <= patterns.sum()


def test_knapsack_is_best():
    rng = np.random.default_rng(1)
    price = rng.random(6)
    worth, counts = P.best_pattern(price, 9)

    def every(room, kinds):
        if not kinds:
            return 0.0
        return max(k * price[kinds - 1] + every(room - k * kinds, kinds - 1) for k in range(room // kinds + 1))

    assert worth == pytest.approx(every(9, 6)) and counts @ np.arange(1, 7) <= 9
