"""Packing tokenised documents into as few sequences as possible by the sum-of-squares rule.

A document goes, uncut, into the open sequence for which the sum over all gaps of (open sequences with that gap)^2
becomes smallest, or into a new one. Ties go to the smallest gap. The rule keeps the gaps varied, so that
later documents find one that they fill.

1. Documents become token ids and an end id, cut every ``SEQUENCE`` ids; full pieces are sequences of their own. The
   pieces are written once.
2. Only (key, length) of the others is dealt, to groups of about ``GROUP`` pieces by a hash. A group is packed by one task,
   with two arrays of counts by gap and lists of open sequences. Long pieces come first, by classes of lengths;
   inside a class a hash gives the order, because the rule needs varied lengths. Sequences that have a gap are
   packed anew by the rule, in other orders, while that may save some.
3. Sequences with a gap of more than ``SPARE`` are opened again: their pieces, a small part of a group
   whose lengths allow full sequences, are packed in new and fewer groups, until one group is left or no longer less than half
   of the pieces are. A group keeps its former sequences if that takes no more of them. So what each group
   leaves over does not add up.
4. Places are joined to the pieces by key.

Defined cases: a null or empty text is one end id; repeated rows are packed each; an empty table gives no piece; further
columns are left out; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.llm.packing import WordEncoder, tokenizer_path
from captionforge.llm.text import lean, mix, worker_cache
from captionforge.session import materialize, small_batches

SEQUENCE = 2048
END_ID = 0
GROUP = 1 << 17
SPARE = 64
STEPS = (1.2, 1.5, 2.0, 4.0, 1.05)
TRIES = 24

_PIECES = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "part int, number bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
KEY = ["part", "number"]


def _cut(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = worker_cache()
        if held.get("encoder_path") != path:
            held["encoder_path"], held["encoder"] = path, WordEncoder(path)
        part, number, end = TaskContext.get().partitionId(), 0, np.array([END_ID], "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, encoded in held["encoder"].encode(batch.column(1)):
                out = []
                for key, ids in zip(keys[first:], encoded):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), sequence)):
                        own = ids[start:start + sequence]
                        out.append((part, number, key, piece, start, len(own), own.tobytes()))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """A written table of pieces: part and number (their key), doc_id, piece, start, length, ids (little-endian 32 bit)."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(named.mapInArrow(lean(_cut(tokenizer or tokenizer_path(), sequence)), _PIECES_DDL), "pieces")


def fill(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, placed in the given order, and how many sequences there are."""
    # the rule's change of the sum, halved and less one: count[gap - length] - count[gap]. A full sequence counts
    # -1/2 and an unopened one 1/2, which makes the same formula right for them; gaps without a sequence are never chosen
    count = np.zeros(sequence + 1)
    count[0], count[sequence] = -0.5, 0.5
    taken = np.full(sequence + 1, -np.inf)
    taken[sequence] = 0.5
    change = np.empty(sequence + 1)
    opened: list[list[int]] = [[] for _ in range(sequence + 1)]
    into, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        options = np.subtract(count[:sequence - length + 1], taken[length:], out=change[:sequence - length + 1])
        left = int(options.argmin())
        gap = left + length
        if gap == sequence:
            own = used
            used += 1
        else:
            own = opened[gap].pop()
            count[gap] -= 1
            taken[gap] = count[gap] or -np.inf
        if left:
            opened[left].append(own)
            count[left] += 1
            taken[left] = count[left]
        into[i], offset[i] = own, sequence - gap
    return into, offset, used


def pack_lengths(lengths: np.ndarray, keys: np.ndarray, sequence: int = SEQUENCE, tries: int = TRIES) -> tuple[np.ndarray, int]:
    """Sequence of each piece, and how many there are; ``keys`` decide the order inside a class of lengths.

    After a first packing, the sequences that have a gap are packed anew in other orders, and stay so if that takes no
    more of them, up to ``tries`` times or until no packing can have fewer.
    """

    def by_class(chosen: np.ndarray, turn: int) -> np.ndarray:
        step = STEPS[turn % len(STEPS)]
        return chosen[np.lexsort((mix(keys[chosen] + np.uint64(turn)), -np.floor(np.log(lengths[chosen]) / np.log(step))))]

    into, least = np.empty(len(lengths), np.int64), -(-int(lengths.sum()) // sequence)
    order = by_class(np.arange(len(lengths)), 0)
    into[order], _, used = fill(lengths[order], sequence)
    for turn in range(1, tries + 1):
        if used <= least:
            break
        gappy = np.bincount(into, lengths, used) < sequence
        order = by_class(np.flatnonzero(gappy[into]), turn)
        anew, _, n = fill(lengths[order], sequence)
        if n <= gappy.sum():
            kept = used - int(gappy.sum())
            into = (np.cumsum(~gappy) - 1)[into]
            into[order] = kept + anew
            used = kept + n
    return into, used


def _end_to_end(into: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Offset of each piece if those of a sequence follow one another."""
    by = np.argsort(into, kind="stable")
    total = np.cumsum(lengths[by]) - lengths[by]
    head = np.append(True, into[by][1:] != into[by][:-1])
    offset = np.empty(len(into), np.int64)
    offset[by] = total - np.repeat(total[head], np.diff(np.append(np.flatnonzero(head), len(by))))
    return offset


_PLACED = "part int, number bigint, length bigint, sequence_id bigint, offset bigint, gap bigint"


def _pack_group(turn: int, sequence: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        part, number, length, former = (table.column(c).to_numpy() for c in ("part", "number", "length", "sequence_id"))
        order = np.lexsort((number, part))
        part, number, length, former = part[order], number[order], length[order], former[order]
        into, used = pack_lengths(length, mix(part.astype(np.uint64) << np.uint64(40) ^ number.astype(np.uint64)), sequence)
        name = (turn << 58) + (group << 26) + into
        if turn and used >= len(np.unique(former)):
            name, into = former, np.unique(former, return_inverse=True)[1]
        gap = sequence - np.bincount(into, length).astype(np.int64)
        return pa.table([part, number, length, name, _end_to_end(into, length), gap[into]], ["part", "number", "length", "sequence_id", "offset", "gap"])

    return run


def place(pieces: DataFrame, sequence: int = SEQUENCE, group: int = GROUP, spare: int = SPARE) -> DataFrame:
    """(part, number, sequence_id, offset) of each piece of ``pieces`` (part, number, length; read several times).

    Sequence ids are any numbers.
    """
    whole = pieces.where(F.col("length") == sequence).select(
        *KEY, (-F.lit(1) - F.shiftleft(F.col("part").cast("long"), 40) - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < sequence).select(*KEY, "length", F.lit(0).cast("long").alias("sequence_id"))
    done, turn = [whole], 0
    n = left.count()
    while True:
        groups = max(1, -(-n // group))
        # a sequence that is opened again stays in one group
        dealt = left.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), *(["sequence_id"] if turn else KEY)), F.lit(groups)))
        placed = materialize(dealt.groupBy("group").applyInArrow(_pack_group(turn, sequence), _PLACED), "placed")
        turn += 1
        rest = placed.where(F.col("gap") > spare)
        again = rest.count() if groups > 1 else 0
        closed = placed.where(F.col("gap") <= spare) if 0 < again <= n / 2 else placed
        done.append(closed.select(*KEY, "sequence_id", "offset"))
        if closed is placed:
            break
        left, n = rest.select(*KEY, "length", "sequence_id"), again
    every = done[0]
    for part in done[1:]:
        every = every.union(part)
    return every


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    The ids of a sequence, by offset, are a training sequence to be padded to ``sequence``.
    """
    pieces = cut(docs, id_col, text_col, tokenizer, sequence)
    return pieces.join(place(pieces, sequence), KEY).drop(*KEY)
