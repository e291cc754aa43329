"""Packing tokenised documents into sequences by cutting-stock column generation.

1. Documents become token ids and an end id. Every full ``SEQUENCE`` of a long document is a sequence of its
   own; what is left of each document, shorter than that, is an item. Remainders below ``SHORT`` tokens are
   laid end to end, in bundles of at most ``BUNDLE`` tokens, and a bundle is one item.
2. The histogram of item lengths in units of ``GRID`` tokens (at most SEQUENCE / GRID classes, whatever the
   number of documents) goes to the driver. A linear program over patterns - how many items of each class
   fill one sequence - is solved by column generation: a revised simplex keeps the basis, and a knapsack
   dynamic program prices all patterns at once.
3. Patterns are used a whole number of times. Items are ranked inside their class (a count per task and class,
   and a rank inside the task, so that no class is sorted), and the rank says which copy of which pattern
   and which place in it an item has.
4. The items that rounding leaves over, at most a basis of patterns, are laid end to end and cut at
   sequence borders.

Only item 4 and documents longer than a sequence are cut. Padding is the rounding to GRID and the last
sequence. Defined cases: a null or empty text is one end id; repeated rows are packed each; an empty table
gives no piece; further columns are left out; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from captionforge.llm.text import LOWER, lean, text_bytes, word_hashes, worker_cache
from captionforge.session import in_tasks, materialize, small_batches, small_columns

SEQUENCE = 2048
GRID = 8
SHORT = 64          # rounding to GRID would be a large part of shorter items
BUNDLE = 512
END_ID = 1
GAP = 1e-3          # the linear program stops this close to its bound
CACHED_WORDS = 500_000
GROUP_BYTES = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPACE, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, each distinct word encoded once.

    The tokenizer cuts a text into runs of letters, single digits and runs of other characters before it looks
    for tokens, so the ids of a text are those of its words one after the other. Words end at a
    space, tab or line break and between an ASCII letter and an ASCII mark other than an apostrophe; all
    rarer borders are left to the tokenizer. Words are told apart by 64-bit hashes of their bytes, A-Z in lower
    case. Up to ``CACHED_WORDS`` are kept, then the table starts anew. A text that contains one of the
    tokenizer's special strings is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        # one text of all new words; the offsets tell which ids are whose
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        cuts = np.searchsorted(at, np.cumsum([0] + [len(w) + 1 for w in words]))
        if len(self.hashes) + len(words) > CACHED_WORDS:
            self._clear()
        into = np.searchsorted(self.hashes, hashes)  # both are sorted
        self.hashes = np.insert(self.hashes, into, hashes)
        self.begins = np.insert(self.begins, into, cuts[:-1] + len(self.ids))
        self.sizes = np.insert(self.sizes, into, np.diff(cuts))
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each row) by groups of rows."""
        raw, at = text_bytes(texts)
        row, n = 0, len(at) - 1
        while row < n:
            upto = max(row + 1, int(np.searchsorted(at, at[row] + GROUP_BYTES, "right")) - 1)
            yield row, self._group(raw[at[row]:at[upto]], at[row:upto + 1] - at[row])
            row = upto

    def _group(self, raw: np.ndarray, text_start: np.ndarray) -> list[np.ndarray]:
        lower, kind = LOWER[raw], _KIND[raw]
        before = np.empty(len(kind), np.uint8)
        before[:1], before[1:] = _SPACE, kind[:-1]
        fresh = np.zeros(len(kind) + 1, dtype=bool)
        fresh[text_start] = True
        fresh = fresh[:-1]
        cut = (before == _LETTER) & (kind == _MARK) | (before == _MARK) & (kind == _LETTER)
        start = np.flatnonzero((kind != _SPACE) & (fresh | (before == _SPACE) | cut))
        # a word ends where the next begins, or at the white space before that
        gone = np.append(np.flatnonzero((kind == _SPACE) | fresh), len(kind))
        end = np.minimum(np.append(start[1:], len(kind)), gone[np.searchsorted(gone, start, "right")])
        hashes, first, word = np.unique(word_hashes(lower, start, end), return_index=True, return_inverse=True)
        place, known = self._places(hashes)
        if not known.all():
            new = np.flatnonzero(~known)
            words = [lower[start[i]:end[i]].tobytes().decode("utf-8", "replace") for i in first[new]]
            if len(self.hashes) + len(new) > CACHED_WORDS:  # start anew with all words of this group
                new, words = np.arange(len(hashes)), [lower[start[i]:end[i]].tobytes().decode("utf-8", "replace") for i in first]
            self._learn(hashes[new], words)
            place, _ = self._places(hashes)
        begins, sizes = self.begins[place][word], self.sizes[place][word]
        total = np.cumsum(sizes)
        flat = self.ids[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.append(0, total)[np.searchsorted(start, text_start)]
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        places = np.array([x for special in self.special for x in _occurrences(raw, special.encode())], np.int64)
        for r in np.unique(np.searchsorted(text_start, places, "right") - 1):
            text = raw[text_start[r]:text_start[r + 1]].tobytes().decode("utf-8", "replace")
            out[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out


def _occurrences(raw: np.ndarray, what: bytes) -> Iterator[int]:
    data, at = raw.tobytes(), -1
    while (at := data.find(what, at + 1)) >= 0:
        yield at


_CUT = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("class", pa.int32()), ("rank", pa.int64()),
                  ("inner", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_CUT_DDL = "doc_id bigint, part int, number bigint, class int, rank bigint, inner bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def _tokenise(path: str, sequence: int, grid: int):
    """Full sequences (class 0) and one remainder of each document, ranked by class inside the task.

    The pieces of a bundle have its class and rank, and their places in it (``inner``).
    """
    bundle = min(BUNDLE, sequence // 4)
    short = min(SHORT, bundle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = worker_cache()
        if held.get("encoder_path") != path:
            held["encoder_path"], held["encoder"] = path, WordEncoder(path)
        encoder, part = held["encoder"], TaskContext.get().partitionId()
        ranks, number, waiting, size = np.zeros(-(-sequence // grid) + 1, np.int64), 0, [], 0
        end = np.array([END_ID], "<u4")

        def item(pieces: list[tuple]) -> Iterator[tuple]:
            nonlocal number
            length = sum(p[2] for p in pieces)
            kind, inner = 0 if length == sequence else -(-length // grid), 0
            for key, start, own, total, ids in pieces:
                yield key, part, number, kind, int(ranks[kind]), inner, start, own, total, ids
                inner += own
                number += 1
            ranks[kind] += 1

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_CUT)], schema=_CUT)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, encoded in encoder.encode(batch.column(1)):
                out = []
                for at, tokens in enumerate(encoded, first):
                    tokens = np.concatenate([tokens, end])
                    for start in range(0, len(tokens), sequence):
                        length = min(sequence, len(tokens) - start)
                        piece = keys[at], start, length, len(tokens), tokens[start:start + length].tobytes()
                        if length >= short:
                            out += item([piece])
                            continue
                        if waiting and size + length > bundle:
                            out += item(waiting)
                            waiting, size = [], 0
                        waiting.append(piece)
                        size += length
                yield table(out)
        if waiting:
            yield table(list(item(waiting)))

    return run


def best_pattern(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``capacity`` units by items of 1..len(price) units, any number of each."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        most = min(room, len(price))
        offers = price[:most] + value[room - 1::-1][:most]
        pick = int(offers.argmax())
        if offers[pick] > value[room - 1] + 1e-12:
            value[room], choice[room] = offers[pick], pick + 1
        else:
            value[room] = value[room - 1]
    counts, room = np.zeros(len(price), np.int64), capacity
    while room > 0:
        if choice[room]:
            counts[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[capacity]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, one vectorised step per row.

    The driver's process has forked, and threads of a numerical library may not have survived that.
    """
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def solve(demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: items of each class) and how often each is used, in fractions, to cover ``demand``.

    ``demand[i]`` items have ``i + 1`` units. Column generation: the simplex multipliers price the classes, the
    knapsack finds the best pattern, it enters the basis. It ends when no pattern is worth more than one
    sequence, or when the bound value / best pattern is within ``gap``.
    """
    kinds = np.flatnonzero(demand > 0)
    if not len(kinds):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    sizes = kinds + 1
    need = demand[kinds].astype(float)
    patterns = np.diag(capacity // sizes).astype(np.int64)  # column j: only items of class j
    inverse = np.diag(1.0 / np.diag(patterns))
    used = inverse @ need
    bound = float((need * sizes).sum()) / capacity  # no padding at all
    for step in range(60 * len(kinds) + 200):
        price_of = inverse.sum(axis=0)
        price = np.zeros(int(sizes[-1]))
        price[kinds] = np.maximum(price_of, 0)
        worth, counts = best_pattern(price, capacity)
        bound = max(bound, used.sum() / max(worth, 1.0))
        if worth <= 1 + 1e-9 or used.sum() <= bound * (1 + gap):
            break
        column = counts[kinds].astype(float)
        moved = np.einsum("ij,j->i", inverse, column)
        able = moved > 1e-9
        if not able.any():
            break
        ratio = np.where(able, used / np.where(able, moved, 1), np.inf)
        leaving = int(ratio.argmin())
        patterns[:, leaving] = counts[kinds]
        if step % 100 == 99:
            inverse = _inverse(patterns.astype(float))
        else:
            row = inverse[leaving] / moved[leaving]
            inverse -= np.outer(moved, row)
            inverse[leaving] = row
        used = np.maximum(np.einsum("ij,j->i", inverse, need), 0)
    whole = np.zeros((len(kinds), len(demand)), np.int64)
    whole[:, kinds] = patterns.T
    return whole, used


_PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "upto", "each", "sequence", "offset", "stride")])


def place_table(demand: np.ndarray, sequence: int = SEQUENCE, grid: int = GRID) -> tuple[list[tuple], np.ndarray, int]:
    """Rows (class, first rank, past the last, items of the class in a pattern, first sequence, offset, stride), the
    items of each class they place, and the sequences they fill.

    The item of rank r has copy (r - first) // each of the pattern, and place (r - first) % each there.
    """
    patterns, used = solve(demand, sequence // grid)
    rows, placed, filled = [], np.zeros(len(demand), np.int64), 0
    for pattern, times in zip(patterns, used):
        # whole copies, of as many items as there are
        held = pattern > 0
        copies = int(min(np.floor(times + 1e-9), *((demand[held] - placed[held]) // pattern[held]))) if held.any() else 0
        if copies <= 0:
            continue
        offset = 0
        for kind in np.flatnonzero(held)[::-1]:
            each, size = int(pattern[kind]), (int(kind) + 1) * grid
            rows.append((int(kind) + 1, int(placed[kind]), int(placed[kind]) + each * copies, each, filled, offset, size))
            placed[kind] += each * copies
            offset += each * size
        filled += copies
    return rows, placed, filled


_PIECE = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE,
         grid: int = GRID, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bit).

    Sequences are numbered without order; the ids of one, by offset, are a training sequence to be padded
    to ``sequence``. ``of`` makes of the ids of a piece what then stands in their column, such as a digest:
    pieces meet in their sequences without their ids, which are nearly all of what is shuffled and sorted.
    """
    of = of or (lambda ids: ids)
    spark = docs.sparkSession
    small_batches(spark)
    small_columns(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialize(named.mapInArrow(lean(_tokenise(tokenizer or tokenizer_path(), sequence, grid)), _CUT_DDL), "tokens")
    # one row per task and class
    counts = cut.where("inner = 0").groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(in_tasks(counts, len(cut.inputFiles()) * (sequence // grid + 1)), "counts")
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    demand = np.zeros(sequence // grid, np.int64)
    full = 0
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        if row["class"]:
            demand[row["class"] - 1] = row["n"]
        else:
            full = row["n"]
    rows, placed, filled = place_table(demand, sequence, grid)
    first = lambda kind: F.get(F.lit([0, *placed.tolist()]), kind)
    items = cut.join(bases, ["part", "class"]).withColumn("rank", F.col("rank") + F.col("base"))
    whole = items.where("class = 0").select(
        "doc_id", "start", "length", "doc_tokens", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), of(F.col("ids")).alias("ids"))
    # the places of a class, at most one per pattern, found by a search over their first ranks
    by_class: dict[int, list[tuple]] = {}
    for kind, *place in rows:
        by_class.setdefault(kind, []).append(tuple(place))
    known = spark.createDataFrame([(k, v) for k, v in by_class.items()], T.StructType([
        T.StructField("class", T.IntegerType()), T.StructField("places", T.ArrayType(_PLACE))]))
    fit = items.where((F.col("class") > 0) & (F.col("rank") < first(F.col("class")))).join(known, "class")
    fit = fit.withColumn("place", F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["upto"]))[0])
    into = F.col("rank") - F.col("place.first")
    fit = fit.select("doc_id", "start", "length", "doc_tokens", of(F.col("ids")).alias("ids"),
                     (F.floor(into / F.col("place.each")).cast("long") + F.col("place.sequence") + full).alias("sequence_id"),
                     (F.col("place.offset") + into % F.col("place.each") * F.col("place.stride") + F.col("inner")).alias("offset"))
    # grid steps leave gaps: the items of a sequence close up
    inside = Window.partitionBy("sequence_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    closed = fit.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    # what rounding leaves: less than one copy of each pattern of a basis, so bounded whatever the input
    rest = materialize(items.where((F.col("class") > 0) & (F.col("rank") >= first(F.col("class")))).select(
        "part", "number", "doc_id", "start", "length", "doc_tokens", "ids"), "rest")
    line = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    laid = rest.withColumn("begin", F.coalesce(F.sum("length").over(line), F.lit(0)))
    slot = F.explode(F.sequence(F.floor(F.col("begin") / sequence), F.floor((F.col("begin") + F.col("length") - 1) / sequence)))
    laid = laid.withColumn("slot", slot)
    lo = F.greatest(F.col("begin"), F.col("slot") * sequence)
    hi = F.least(F.col("begin") + F.col("length"), (F.col("slot") + 1) * sequence)
    laid = laid.select(
        "doc_id", (F.col("start") + lo - F.col("begin")).alias("start"), (hi - lo).alias("length"), "doc_tokens",
        (F.col("slot") + full + filled).alias("sequence_id"), (lo - F.col("slot") * sequence).alias("offset"),
        of(F.substring("ids", (4 * (lo - F.col("begin")) + 1).cast("int"), (4 * (hi - lo)).cast("int"))).alias("ids"))
    return whole.select(_PIECE).union(closed.select(_PIECE)).union(laid.select(_PIECE))
