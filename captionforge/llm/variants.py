"""Spelling variants of the words of a corpus, by blocked Gram matrices of letter counts.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Then the squared distance of
their letter counts is 1 or 2, and all such distances inside a block come from one NumPy product of its
letter-count matrix with itself.

1. Words are counted over all texts: per task first, with a bounded table, then by Spark. Rare and short ones go.
2. A block holds words of one length m and of length m + 1. The places 0..m of the shorter word are cut in two
   halves; the words of a block agree outside one half (by a hash of what stands before and behind it), so a
   pair is in the block of the half that holds its edit, and in no other.
3. A block of more than ``BLOCK`` words is cut again: its half is halved, and each word goes to both parts. This
   ends, at the latest, when one place is left; words that agree but for one or two letters are
   as many as the square of the alphabet, whatever the input. No pair is lost and no group is capped.
4. Blocks of like size are stacked and multiplied together. Pairs at a squared distance of at most two, in the
   same or adjacent lengths, are verified letter by letter.
5. The form of a word is its most frequent near word, if that is ``FACTOR`` times as frequent. Forms are followed to the
   last one by doubling: frequencies grow by ``FACTOR`` with each step, so a chain is short.

Defined cases: a null or empty text has no words; repeated rows count each; an empty table gives an empty table; other
columns are not looked at; a null id is written as nothing where an id is asked for.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import lean
from captionforge.session import discard, materialize, small_batches

MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
BLOCK = 512
KEPT_WORDS = 200_000    # entries of a task's table of counts
STACK = 1 << 20         # numbers in a stack of letter-count matrices, and in its products
TILE = 1024             # larger blocks, which cannot be cut any more, are multiplied by tiles

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")  # letters and U+00C0 to U+00FF, as UTF-8


def _without_one(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _counter(min_length: int, slips: int | None):
    """(word, n) of a task's texts; a word may come several times."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = [w for w in counts if len(w) >= min_length]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                found = Counter(w for w in _RUN.findall(text.as_py().encode().lower()) if len(w) >= min_length)
                if slips:
                    begin = zlib.crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                    for word in [w for w in found if zlib.crc32(w, begin) % slips == 0]:
                        counts[_without_one(word, zlib.crc32(word, begin))] += found.pop(word)
                counts.update(found)
                if len(counts) > KEPT_WORDS:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    return run


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                slips: int | None = None) -> DataFrame:
    """(word, n) of words of at least ``min_length`` code points that occur at least ``min_count`` times in all texts.

    A word is a longest stretch of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With ``slips``, typing errors
    are planted: where the CRC-32 of ``<id>:<word>`` is a multiple of it, the word loses the code point at that
    number modulo its length.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    counted = texts.mapInArrow(lean(_counter(min_length, slips)), "word string, n bigint")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


LETTERS = 96
_OF_LETTER = np.append(90 + np.arange(256) % 6, 0)
_OF_LETTER[97:123] = np.arange(26)
_OF_LETTER[192:256] = 26 + np.arange(64)


class _Words:
    """Words of an Arrow array as code points, one after the other."""

    def __init__(self, words: pa.Array):
        self.words = words.to_pylist()
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join([*self.words, " "]).encode("utf-32-le"), np.uint32)[:-1]

    def letter_counts(self, chosen: np.ndarray) -> np.ndarray:
        """One row of counts per word. Letters that share a column only make a distance smaller."""
        size = self.size[chosen]
        at = np.arange(size.sum()) + np.repeat(self.begin[chosen] - (np.cumsum(size) - size), size)
        code = self.codes[at]
        column = np.where(code < 256, _OF_LETTER[np.minimum(code, 255)], 90 + code % 6)
        row = np.repeat(np.arange(len(chosen)), size)
        return np.bincount(row * LETTERS + column, minlength=len(chosen) * LETTERS).reshape(-1, LETTERS).astype(np.float32)

    def _agreeing(self, x: np.ndarray, y: np.ndarray, backwards: bool) -> np.ndarray:
        most, agree = np.minimum(self.size[x], self.size[y]), np.zeros(len(x), np.int64)
        first_x, first_y = (self.begin + self.size - 1 if backwards else self.begin)[np.stack([x, y])]
        step, on = -1 if backwards else 1, np.arange(len(x))
        while len(on):
            on = on[agree[on] < most[on]]
            on = on[self.codes[first_x[on] + step * agree[on]] == self.codes[first_y[on] + step * agree[on]]]
            agree[on] += 1
        return agree

    def one_edit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words x and y (the longer one, if any) differ by one edit, and how many code points they begin with alike."""
        before, behind = self._agreeing(x, y, False), self._agreeing(x, y, True)
        same = self.size[x] == self.size[y]
        return np.where(same, before + behind == self.size[x] - 1, before + behind >= self.size[x]), before


def _close_pairs(words: _Words, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block, word, word) at a squared distance of at most two, in blocks ``first`` to ``first + size``."""
    width = 2
    while width <= TILE and (size > width // 2).any():
        own = np.flatnonzero((size <= width) & (size > width // 2) & (size > 1))
        per = max(1, STACK // (width * max(width, LETTERS)))
        for at in range(0, len(own), per):
            block = own[at:at + per]
            place = np.arange(width)
            inside = place < size[block, None]
            member = np.where(inside, first[block, None] + place, 0)
            counts = np.zeros((len(block), width, LETTERS), np.float32)
            counts[inside] = words.letter_counts(member[inside])
            gram = counts @ counts.transpose(0, 2, 1)
            norm = np.diagonal(gram, axis1=1, axis2=2)
            near = (norm[:, :, None] + norm[:, None, :] - 2 * gram <= 2.5) & inside[:, :, None] & inside[:, None, :]
            near &= place[:, None] < place
            b, i, j = np.nonzero(near)
            yield block[b], member[b, i], member[b, j]
        width *= 2
    for block in np.flatnonzero(size > TILE):
        tiles = [np.arange(at, min(at + TILE, first[block] + size[block])) for at in range(first[block], first[block] + size[block], TILE)]
        for k, left in enumerate(tiles):
            x = words.letter_counts(left)
            for right in tiles[k:]:
                y = words.letter_counts(right)
                distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
                i, j = np.nonzero((distance <= 2.5) & (left[:, None] < right))
                yield np.full(len(i), block), left[i], right[j]


_NEAR = "word string, n_near bigint, most bigint, form string"


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a batch of blocks: how many near words it has there, and the most frequent one."""
    for batch in batches:
        m, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = batch.column(2)
        size = rows.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        members = rows.flatten()
        words, n = _Words(members.field("word")), members.field("n").to_numpy()
        pairs = [np.zeros((2, 0), np.int64)]
        for block, x, y in _close_pairs(words, first, size):
            # the shorter word first; two longer ones belong to another block
            x, y = np.where(words.size[x] <= words.size[y], x, y), np.where(words.size[x] <= words.size[y], y, x)
            fits = words.size[x] == m[block]
            block, x, y = block[fits], x[fits], y[fits]
            edit, before = words.one_edit(x, y)
            # an inserted code point belongs to the block that holds the first place where the words differ
            mine = edit & ((words.size[x] == words.size[y]) | (before < b[block]) | (b[block] == m[block]))
            pairs.append(np.stack([x[mine], y[mine]]))
        x, y = np.concatenate(pairs, axis=1)
        if not len(x):
            continue
        name = {w: i for i, w in enumerate(sorted(set(words.words)))}
        rank = np.array([name[w] for w in words.words])
        own, other = rank[np.concatenate([x, y])], np.concatenate([y, x])
        order = np.lexsort((rank[other], -n[other], own))
        own, other = own[order], other[order]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        spelled = list(name)
        yield pa.RecordBatch.from_arrays([
            pa.array([spelled[i] for i in own[head]], pa.string()), pa.array(np.diff(np.append(head, len(own))), pa.int64()),
            pa.array(n[other[head]], pa.int64()), pa.array([words.words[i] for i in other[head]], pa.string())],
            ["word", "n_near", "most", "form"])


_BLOCK = ["m", "a", "b", "key"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b) with the hash of what stands outside the places a to b of a word of length m."""
    longer = (F.char_length("word") - F.col("m")).cast("int")
    outside = F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("a")), F.expr("substring(word, b + 1 + cast(char_length(word) - m as int))"))
    return rows.withColumns({"key": outside, "short": longer == 0})


def _halves(words: DataFrame) -> DataFrame:
    """Each word as the shorter and as the longer word of a pair, with the edit in either half."""
    half = lambda m: [F.struct(m.alias("m"), F.lit(0).alias("a"), F.floor(m / 2).cast("int").alias("b")),
                      F.struct(m.alias("m"), F.floor(m / 2).cast("int").alias("a"), m.alias("b"))]
    size = F.char_length("word").cast("int")
    return _keyed(words.select("word", "n", F.inline(F.array(*half(size), *half(size - 1)))))


def _cut_again(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct("m", "a", middle.alias("b")), F.struct("m", middle.alias("a"), "b"))
    return _keyed(rows.select("word", "n", F.inline(parts)))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, most, form) of words with a near word among the distinct words of ``words`` (word, n).

    ``form`` is the near word of the largest count ``most``; ties go to the smallest in code-point order. Words are not empty.
    """
    spark = words.sparkSession
    small_batches(spark)
    rows, found, held = _halves(words), [], []
    while True:
        sizes = materialize(rows.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("size"), F.max("short").alias("any_short"))
                            .where("size > 1 and any_short").drop("any_short"), "blocks")
        large = (F.col("size") > block) & (F.col("b") - F.col("a") > 1)
        sized = rows.join(sizes, _BLOCK)
        stacked = sized.where(~large).groupBy(_BLOCK).agg(F.collect_list(F.struct("word", "n")).alias("members")).select("m", "b", "members")
        found.append(materialize(stacked.mapInArrow(lean(_near_words), _NEAR), "near"))
        more = sizes.where(large).limit(1).count()
        cut = materialize(_cut_again(sized.where(large)).select("word", "n", "m", "a", "b"), "cut-blocks") if more else None
        discard(sizes, *held)
        if cut is None:
            break
        rows, held = _keyed(cut), [cut]
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("form").alias("form"))).alias("best")
    total = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    whole = materialize(total.select("word", "n_near", (-F.col("best.less")).alias("most"), F.col("best.form").alias("form")), "near-words")
    discard(*found)
    return whole


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to the last one. Chains end, and each word has one form."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                          F.col("next").isNotNull().alias("moved")), "roots")
        discard(links)
        links = doubled
        if not links.where("moved").limit(1).count():
            return links.drop("moved")
        links = links.drop("moved")
        links._scratch_path = doubled._scratch_path


def spelling_variants(words: DataFrame, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """``words`` (word, n; distinct) with n_near, form, form_n and root.

    A word has a form if its most frequent near word is at least ``factor`` times as frequent; its root is the
    last of the chain of forms, or the word itself.
    """
    if factor < 2:
        raise ValueError(f"factor is at least 2, not {factor}: chains of forms would not end")
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, block)
    frequent = F.col("most") >= factor * F.col("n")
    judged = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("form")).alias("form"), F.when(frequent, F.col("most")).alias("form_n")), "judged")
    discard(words, near)
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
