"""Runs of repeated words, found with a grammar made by recompression.

A run is a stretch of words with smallest period q and a length of at least max(``MIN_LENGTH``, 2 q) that no
neighbouring word extends with that period.

1. The words of a group of texts become numbers, each text is followed by a number of its own. Two steps
   alternate until every text is a few symbols: blocks of equal symbols become one symbol (a run-length rule),
   and neighbours that a random halving of the alphabet puts left and right become one symbol (a pair rule). Equal
   stretches are parsed alike but for a few symbols at their ends.
2. How far two places of a text agree (their longest common extension) is read from the grammar: both climb
   while they agree, at most two symbols a level, and go down again where they differ. Many questions are
   answered at once, level by level; the same levels read from right to left answer extensions to the left.
3. In a run of period q, max(q, MIN_LENGTH - q) words in a row equal the word q places on. One of each
   that many places is therefore inside (a harmonic sum over all q: n log n candidates for n words). Where the two
   words are equal, the extensions to both sides give the run exactly. A stretch found with several periods has the
   smallest of them.

Each text is looked at alone, in one Arrow batch function, so nothing is shuffled and lost executors cost only
their tasks. Candidates are taken in blocks, and memory follows a group of texts of ``GROUP_BYTES`` or one larger text.

Defined cases: a null or empty text, or one without words, has no runs and an empty collapsed text; repeated rows are
looked at each; an empty table gives an empty table; other columns, whatever their names, and null ids stay as they are.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import lean, mix, text_bytes
from captionforge.session import small_batches

MIN_LENGTH = 12
GROUP_BYTES = 1 << 19
CANDIDATES = 1 << 19    # candidates looked at together
FEW = 4                 # symbols a text may keep at the top
MAX_ROUNDS = 300


@dataclass
class Level:
    """A sequence of symbols, and how the next level groups it: ``starts`` marks the first symbol of each group."""

    symbols: np.ndarray
    starts: np.ndarray
    parent: np.ndarray      # group of each symbol
    first: np.ndarray       # first symbol of each group, and one past the last symbol
    blocks: bool

    def mirrored(self) -> Level:
        return _level(self.symbols[::-1], np.append(self.starts[1:], True)[::-1], self.blocks)


def _level(symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> Level:
    return Level(symbols, starts, np.cumsum(starts) - 1, np.append(np.flatnonzero(starts), len(symbols)), blocks)


def _new_symbols(key: np.ndarray, joined: np.ndarray, single: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """Symbols of the next level: equal keys get equal new numbers from ``fresh`` on, groups of one keep theirs."""
    out = single.copy()
    kinds, at = np.unique(key[joined], return_inverse=True)
    out[joined] = fresh + at
    return out, fresh + len(kinds)


def recompress(words: np.ndarray, ends: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """The levels of the grammar, and the sequence at its top.

    ``words`` are numbers from 0 on. ``ends`` marks places whose number occurs once; they are never grouped.
    """
    levels, symbols, apart = [], words.astype(np.int64), ends.copy()
    fresh = int(symbols.max()) + 1 if len(symbols) else 0
    for turn in range(MAX_ROUNDS):
        borders = np.flatnonzero(apart)
        if len(borders) < 2 or np.diff(borders).max() <= FEW + 1:
            break
        same = symbols[1:] == symbols[:-1]
        if same.any():
            level = _level(symbols, np.append(True, ~same), True)
            sizes, heads = np.diff(level.first), symbols[level.first[:-1]]
            symbols, fresh = _new_symbols(heads * (int(sizes.max()) + 1) + sizes, sizes > 1, heads, fresh)
            apart = apart[level.first[:-1]]
            levels.append(level)
        right = (mix(symbols.astype(np.uint64) * np.uint64(2 * MAX_ROUNDS) + np.uint64(turn)) & np.uint64(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & ~apart[:-1] & ~apart[1:]
        if pair.any():
            level = _level(symbols, np.append(True, ~pair), False)
            heads, joined = symbols[level.first[:-1]], np.diff(level.first) == 2
            seconds = symbols[np.minimum(level.first[:-1] + 1, len(symbols) - 1)]
            symbols, fresh = _new_symbols(heads * fresh + seconds, joined, heads, fresh)
            apart = apart[level.first[:-1]]
            levels.append(level)
    return levels, symbols


def _step(p: np.ndarray, q: np.ndarray, on: np.ndarray, symbols: np.ndarray) -> None:
    """Where ``on``, both places go on if their symbols are equal."""
    by = on & (symbols[p] == symbols[q])
    p += by
    q += by


def common_extension(levels: list[Level], top: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many symbols from ``p`` and ``q`` on are equal, for each pair of different places.

    The places must not be behind the last number that occurs once.
    """
    p, q = p.astype(np.int64), q.astype(np.int64)
    begin, alive, climbed = p.copy(), np.arange(len(p)), []
    for level in levels:
        climbed.append(alive)
        a, b = p[alive], q[alive]
        if level.blocks:
            free = level.starts[a] & level.starts[b]
            size_a = level.first[level.parent[a] + 1] - a
            size_b = level.first[level.parent[b] + 1] - b
            equal = ~free & (level.symbols[a] == level.symbols[b])
            by = np.where(equal, np.minimum(size_a, size_b), 0)
            a, b = a + by, b + by
            up = free | equal & (size_a == size_b)
        else:
            for _ in range(2):
                _step(a, b, ~(level.starts[a] & level.starts[b]), level.symbols)
            up = level.starts[a] & level.starts[b]
        p[alive], q[alive] = a, b
        alive = alive[up]
        p[alive], q[alive] = level.parent[a[up]], level.parent[b[up]]
        if not len(alive):
            break
    else:
        moving = alive
        while len(moving):
            moving = moving[top[p[moving]] == top[q[moving]]]
            p[moving] += 1
            q[moving] += 1
    # where two symbols differ, their parts may still begin alike
    for depth in range(len(climbed) - 1, -1, -1):
        level = levels[depth]
        above = climbed[depth + 1] if depth + 1 < len(climbed) else alive
        a, b = level.first[p[above]], level.first[q[above]]
        if level.blocks:
            equal = level.symbols[a] == level.symbols[b]
            by = np.where(equal, np.minimum(level.first[level.parent[a] + 1] - a, level.first[level.parent[b] + 1] - b), 0)
            a, b = a + by, b + by
        else:
            _step(a, b, np.ones(len(a), dtype=bool), level.symbols)
        p[above], q[above] = a, b
    return p - begin


def _candidates(begin: np.ndarray, size: np.ndarray, min_length: int):
    """(place, period) of harmonic grids over all texts, in blocks."""
    most = np.where(size >= min_length, size // 2, 0)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(period, min_length - period)
    count = -((period - size[text]) // step)
    total = np.append(0, np.cumsum(count))
    at = 0
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + CANDIDATES, "right")) - 1)
        own = count[at:upto]
        index = np.arange(total[upto] - total[at]) - np.repeat(total[at:upto] - total[at], own)
        yield np.repeat(begin[text[at:upto]], own) + index * np.repeat(step[at:upto], own), np.repeat(period[at:upto], own)
        at = upto


def runs_of_texts(words: np.ndarray, begin: np.ndarray, size: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (place, length, period) of all runs, by place and period.

    Text i has the words ``begin[i]`` to ``begin[i] + size[i]``; before the first, between texts and behind the last is one
    number that occurs once.
    """
    ends = np.ones(len(words), dtype=bool)
    ends[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)] = False
    found, levels, back = [], None, None
    last = len(words) - 1
    for place, period in _candidates(begin, size, min_length):
        equal = words[place] == words[place + period]
        place, period = place[equal], period[equal]
        if not len(place):
            continue
        if levels is None:
            levels, top = recompress(words, ends)
            back = [level.mirrored() for level in levels]
            top_back = top[::-1]
        after = common_extension(levels, top, place, place + period)
        before = common_extension(back, top_back, last - place + 1, last - place - period + 1)
        long = after + before >= np.maximum(period, min_length - period)
        start, stop, period = (place - before)[long], (place + after + period)[long], period[long]
        if len(start):
            found.append(np.unique(np.stack([start, stop, period], axis=1), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    least = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))  # the smallest period of a stretch comes first
    start, stop, period = rows[least].T
    order = np.lexsort((period, start))
    return np.stack([start, stop - start, period], axis=1)[order]


def _groups(texts: pa.Array):
    """Lists of texts as bytes, of about GROUP_BYTES together."""
    raw, at = text_bytes(texts)
    row, n = 0, len(at) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + GROUP_BYTES, "right")) - 1)
        yield [raw[at[i]:at[i + 1]].tobytes() for i in range(row, upto)]
        row = upto


_FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _find(min_length: int):
    def run(texts: pa.Array) -> pa.Array:
        counts, sizes, rows, kept = [], [0], [], []
        for group in _groups(texts):
            split = [text.split() for text in group]  # at bytes 9 to 13 and 32
            size = np.array([len(w) for w in split], np.int64)
            begin = np.cumsum(size + 1) - size
            number = defaultdict(itertools.count().__next__)
            words = np.zeros(int((size + 1).sum()) + 1, np.int64)
            for at, own in zip(begin, split):
                words[at:at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            words[np.append(0, begin + size)] = len(number) + np.arange(len(size) + 1)
            found = runs_of_texts(words, begin, size, min_length)
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 0] + found[:, 1], -1)
            gone = np.cumsum(drop) > 0
            cuts = np.searchsorted(found[:, 0], begin), np.searchsorted(found[:, 0], begin + size)
            for i, own in enumerate(split):
                if cuts[1][i] > cuts[0][i]:
                    own = list(itertools.compress(own, ~gone[begin[i]:begin[i] + size[i]]))
                kept.append(b" ".join(own))
                sizes.append(int(cuts[1][i] - cuts[0][i]))
            found[:, 0] -= np.repeat(begin, cuts[1] - cuts[0])
            rows.append(found)
            counts.append(size)
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        runs = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), runs),
             pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return run


def runs(text_col: str | Column = "text", min_length: int = MIN_LENGTH) -> Column:
    """Struct of n_words, runs (start word, length, period; by start, then period) and the text collapsed.

    Words are stretches without white space. ``collapsed`` is the words joined by one space, without those
    that a run contains after its first period.
    """
    if min_length < 2:
        raise ValueError(f"min_length is at least 2, not {min_length}")
    find = _find(min_length)

    def batch(texts: pa.Array) -> pa.Array:
        return find(texts)

    return F.arrow_udf(lean(batch), _FOUND)(F.col(text_col) if isinstance(text_col, str) else text_col)


def with_runs(docs: DataFrame, text_col: str = "text", out: str = "found", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with the struct of ``runs`` in a column ``out``, which replaces one of that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, runs(text_col, min_length))


def longest(found: Column) -> Column:
    """The longest of an array of runs; ties go to the smallest start, then period. Null if there is none."""
    ranked = F.transform(found, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"),
                                                   r["length"].alias("length")))
    return F.array_min(ranked)
