"""Sum-of-squares packing: the rule itself, and whole packings."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.llm import squares
from captionforge.llm.packing import tokenizer_path
from captionforge.llm.queries import QUERIES

from .helpers import docs, prose


def plain_rule(lengths, sequence):
    """Every open sequence is tried, and the sum computed anew."""
    gaps, into, offset = [], [], []
    for length in lengths:
        best = None
        for choice in range(len(gaps) + 1):
            after = gaps + [sequence] if choice == len(gaps) else list(gaps)
            if after[choice] < length or (choice < len(gaps) and gaps[choice] == 0):
                continue
            gap = after[choice]
            after[choice] -= length
            counts = defaultdict(int)
            for g in after:
                counts[g] += 0 < g < sequence
            rank = (sum(c * c for c in counts.values()), gap)
            if best is None or rank < best[0]:
                best = rank, choice, gap, after
        _, choice, gap, gaps = best
        into.append(choice)
        offset.append(sequence - gap)
    return gaps, into, offset


@pytest.mark.parametrize("sequence", [5, 12, 40])
def test_rule_against_trying_every_sequence(sequence):
    rng = random.Random(sequence)
    for _ in range(60):
        lengths = [rng.randint(1, sequence - 1) for _ in range(rng.randint(0, 40))]
        into, offset, used = squares.fill(np.array(lengths, np.int64), sequence)
        gaps, _, offsets = plain_rule(lengths, sequence)
        # which of several sequences with one gap is taken does not matter
        assert used == len(gaps) and offset.tolist() == offsets
        level = np.bincount(into, lengths, used) if lengths else np.zeros(0)
        assert sorted(sequence - level) == sorted(gaps)


def test_packing_anew_saves_sequences_and_keeps_pieces():
    rng = np.random.default_rng(7)
    for top, n in ((127, 1000), (60, 400), (127, 1), (127, 0)):
        lengths = rng.integers(1, top + 1, n)
        keys = np.arange(n, dtype=np.uint64)
        once = squares.pack_lengths(lengths, keys, 128, tries=0)
        into, used = squares.pack_lengths(lengths, keys, 128)
        assert used <= once[1] and (n < 1000 or used < once[1])
        level = np.bincount(into, lengths, used) if n else np.zeros(0)
        assert len(level) == used and (level > 0).all() and (level <= 128).all()
        offset = squares._end_to_end(into, lengths) if n else np.zeros(0)
        assert sum(offset + lengths == level[into]) == used


def check_packing(rows, sequence):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert 0 < r.length <= sequence
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
    return len(by_sequence)


@pytest.mark.parametrize("lengths, waste", [("uniform", 0.05), ("short", 0.01), ("long", None), ("equal", 0.0)])
def test_groups_and_rounds(spark, lengths, waste):
    # groups of 300 pieces; uniform lengths up to a whole sequence are the hardest, as each piece needs a partner of its own
    rng = random.Random(4)
    draw = {"uniform": lambda: rng.randint(1, 127), "short": lambda: rng.randint(1, 9), "long": lambda: rng.randint(65, 128), "equal": lambda: 32}[lengths]
    sizes = [draw() for _ in range(4000)]
    pieces = spark.createDataFrame([(i % 7, i // 7, n) for i, n in enumerate(sizes)], "part int, number bigint, length bigint")
    placed = pieces.join(squares.place(pieces, 128, group=300, spare=4), squares.KEY).collect()
    assert len(placed) == 4000
    used = check_packing(placed, 128)
    if waste is not None:
        assert used <= np.ceil(sum(sizes) / 128 * (1 + waste)) + 1
    else:
        assert used == 4000  # no two fit together


def test_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "a", *[prose(rng, rng.choice([1, 3, 30, 200, 900])) for _ in range(60)], prose(rng, 6000)]
    ids = [None, *range(len(texts) - 2), 3]
    frame = docs(spark, texts, ids).withColumns({"piece": F.lit("clash"), "part": F.lit(1), "length": F.lit(1)})
    rows = squares.pack(frame).collect()
    used = check_packing(rows, 2048)
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    want = []
    for key, text in zip(ids, texts):
        own = coder.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(str(key), p, p * 2048, own[p * 2048:(p + 1) * 2048]) for p in range(-(-len(own) // 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted(want)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert used <= -(-sum(len(w[3]) for w in want) // 2048) + 2
    assert squares.pack(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = QUERIES["op13_squares_pack"](spark, sf_dir).collect()
    used = check_packing(rows, 2048)
    total = sum(r.length for r in rows)
    assert used <= total / 2048 * 1.03 + 1
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    seen = defaultdict(int)
    for r in rows:
        ids = np.array(coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        assert r.start + r.length <= len(ids)
    assert set(seen) == set(texts) and total == sum(seen.values())
