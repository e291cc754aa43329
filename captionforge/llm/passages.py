"""Repeated passages across documents by collinear chaining, and their removal.

1. Seeds are the minimisers of ``KMER``-word windows. Every seed occurrence is matched with the first
   document (smallest id) that has the seed, never with all: a batch keeps the first occurrence of each
   seed and matches the others with it, and the first ones of all batches meet in one sort by seed. So
   matches are at most one per seed, and a seed that a third of all documents share costs one row per batch.
2. The matches of two documents are merged along diagonals and chained: a Fenwick tree over the positions
   in the other document gives each block its best predecessor under a gap cost linear in both gaps.
   The seeds of a passage may belong to several earlier documents, none of which has it whole. So stretches of
   matched seeds, joined whatever documents they lead to, are matched once more on longer keys (several seeds in a
   row, and ``MIN_WORDS`` words), again with the first document that has the key, where no passage was found.
3. Chains fetch their words as tiles, one row per tile however many chains ask for it, are extended at
   both ends and aligned between blocks. A chain of at least ``MIN_WORDS`` words and
   ``IDENTITY`` equal words is a repeated passage of the later document; the first keeps its text.
   A document's best chains are aligned first, and the others only where no found passage covers them, so
   near copies, whose seeds lead to many earlier copies, are not aligned with each of these.

Defined cases: null and empty texts have no passage; rows equal in id and text are one document (each gets
the same spans); a null id sorts first; an empty table has no passages; further columns stay as they are.
Repeats inside one document are left alone.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import GROUP_BYTES, IN_WORD, lean, mix, window_hashes, word_groups
from captionforge.session import discard, materialize, shuffles_dropped, small_batches

KMER = 5
WINDOW = 8         # of consecutive k-mers, at least one is a seed
MIN_WORDS = 50
IDENTITY = 0.8
GAP_COST = 0.125   # words of score lost for each word of gap, both documents together
FLANK = 64         # words that an end may be extended
MAX_GAP = 64       # words between neighbouring blocks of a chain, in either document
X_DROP = 10        # an extension stops so far below its best score
TILE = 64

CONTEXT = 8        # words on each side of a seed that its context tells about
UNLIKE = 1 << 31   # bit of a match's place: the contexts differ
KEYS_HELD = 1 << 19  # longer keys that a task holds at once, and those of one more batch

_KEY = ["doc_id", "salt"]
_PLACES = "doc_id bigint, at bigint, r_doc bigint, r_at bigint"


def _salt(text_col: str) -> Column:
    return F.hash(F.coalesce(F.col(text_col), F.lit("")))


def _packed(salt: str, pos: str) -> Column:
    """Salt and place as one number, as rows are dealt: a null salt gives null."""
    return F.shiftleft(F.col(salt).cast("long"), 32).bitwiseOR(F.col(pos).cast("long"))


def _unpacked(matches: DataFrame) -> DataFrame:
    salt, pos = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit(UNLIKE - 1)).cast("int")
    return matches.select("doc_id", salt("at").alias("salt"), pos("at").alias("pos"), "r_doc", salt("r_at").alias("r_salt"), pos("r_at").alias("r_pos"),
                          (F.col("at").bitwiseAND(F.lit(UNLIKE)) != 0).alias("unlike"))


def minimisers(hashes: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices of the smallest hash of every ``window`` neighbours of one row (fewer at a row's ends)."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes)) + (np.cumsum(np.append(0, rows[1:] != rows[:-1])) + 1) * (window - 1)
    n = int(place[-1]) + window
    value = np.full(n + window, np.iinfo(np.uint64).max, np.uint64)
    value[place] = hashes
    best, span = np.arange(n + window), 1
    while span < window:
        step = min(span, window - span)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(value[left] <= value[right], left, right)
        span += step
    back = np.full(n + window, -1, np.int64)
    back[place] = np.arange(len(hashes))
    taken = np.zeros(n + window, dtype=bool)
    taken[best] = True
    chosen = back[taken]
    chosen = chosen[chosen >= 0]
    # in a run of one k-mer every place would be the smallest: keep one in ``window``
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    into = np.arange(len(hashes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hashes)), 0))
    return chosen[into[chosen] % window == 0]


_SEED = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("salt", pa.int32()), ("pos", pa.int32()),
                   ("r_doc", pa.int64()), ("r_salt", pa.int32()), ("r_pos", pa.int32()), ("context", pa.int64()), ("unlike", pa.bool_())])
_SEED_DDL = "h bigint, doc_id bigint, salt int, pos int, r_doc bigint, r_salt int, r_pos int, context bigint, unlike boolean"


def contexts(hashes: np.ndarray, at: np.ndarray, kmer: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Four bits for each of the ``CONTEXT`` words before and after each k-mer, 0 beyond the text (words ``low`` to ``high``)."""
    short = (hashes >> np.uint64(32)) % np.uint64(15) + np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for k in range(CONTEXT):
        for place, shift in ((at - 1 - k, 4 * k), (at + kmer + k, 4 * (CONTEXT + k))):
            inside = (place >= low) & (place < high)
            out |= np.where(inside, short[np.where(inside, place, 0)], np.uint64(0)) << np.uint64(shift)
    return out


def unlike_contexts(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether no more than half of the words agree on either side, in place or moved by one word.

    In a passage a side of each seed lies inside. Where a text ends within half a side, nothing is said.
    """
    alike = np.zeros(len(one), dtype=bool)
    size = np.uint64(4 * CONTEXT)
    for side in (np.uint64(0), size):
        x, y = one >> side, other >> side
        for moved, still in ((x, y), (x >> np.uint64(4), y), (x, y >> np.uint64(4))):
            both, same = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            for k in range(CONTEXT if moved is x and still is y else CONTEXT - 1):
                a, b = moved >> np.uint64(4 * k) & np.uint64(15), still >> np.uint64(4 * k) & np.uint64(15)
                both += (a != 0) & (b != 0)
                same += (a != 0) & (a == b)
            alike |= (2 * same > both) | (both < CONTEXT // 2)
    return ~alike


def _numbered(h: np.ndarray, row: np.ndarray, pos: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The seeds (sorted by row and place), and each later occurrence in a document once more as that occurrence's own seed.

    So the second occurrence in a copy is matched with the second one of the original too.
    """
    order = np.argsort(h, kind="stable")
    h, row, pos, context = h[order], row[order], pos[order], context[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    number = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    again = number > 0
    own = mix(h[again] + number[again].astype(np.uint64))
    return np.concatenate([h, own]), *(np.concatenate([x, x[again]]) for x in (row, pos, context))


def _seeds(kmer: int, window: int):
    """(doc_id, salt, text) to first occurrences (h set) and matches inside the batch (h null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, salts = batch.column(0), batch.column(1)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number, salt = ids.fill_null(0).to_numpy(zero_copy_only=False), salts.to_numpy(zero_copy_only=False)
            order = np.lexsort((salt, number, known))
            fresh = np.ones(len(order), dtype=bool)
            for key in (known, number, salt):
                moved = key[order][1:] != key[order][:-1]
                fresh[1:] = moved if key is known else fresh[1:] | moved
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(fresh)
            hs, rows, places, around = [], [], [], []
            for words in word_groups(batch.column(2)):
                found, first = window_hashes(words, kmer)
                row = words.row[first]
                chosen = minimisers(found, row, window)
                hs.append(found[chosen])
                rows.append(row[chosen] + words.first_row)
                bounds = words.bounds()
                low, high = bounds[row[chosen]], bounds[row[chosen] + 1]
                places.append(first[chosen] - low)
                around.append(contexts(words.hash, first[chosen], kmer, low, high))
            h, row, pos, context = _numbered(*map(np.concatenate, (hs, rows, places, around)))
            # where the rows are in order, so are the occurrences of each seed
            order = np.argsort(h, kind="stable") if (rank[1:] >= rank[:-1]).all() else np.lexsort((pos, rank[row], h))
            h, row, pos, context = h[order], row[order], pos[order], context[order]
            lead = np.ones(len(h), dtype=bool)
            lead[1:] = h[1:] != h[:-1]
            leader = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
            other = rank[row] != rank[row[leader]]
            kept = lead | other
            at, to = np.flatnonzero(kept), leader[kept]
            null = lambda values, kind, mask: pa.array(values, kind, mask=mask)
            unlike = np.zeros(len(at), dtype=bool)
            unlike[other[at]] = unlike_contexts(context[at[other[at]]], context[to[other[at]]])
            far = np.where(lead[kept], -1, row[to])
            far_index = pa.array(far, pa.int64(), mask=far < 0)
            yield pa.RecordBatch.from_arrays([
                null(h[at].view(np.int64), pa.int64(), other[at]),
                ids.take(pa.array(row[at])), salts.take(pa.array(row[at])), pa.array(pos[at], pa.int32()),
                ids.take(far_index), salts.take(far_index), null(pos[to], pa.int32(), lead[at]), null(context[at].view(np.int64), pa.int64(), other[at]),
                pa.array(unlike)], schema=_SEED)

    return run


def _match_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, document, place): each is matched with the first row of its seed; those without h are matched already.

    Where rows have contexts, a match whose contexts differ is marked. Where they have none, a place with bit 31 set is an
    owner only: others are matched with it, it is matched with none.
    """
    carry = None
    names = ["doc_id", "at", "r_doc", "r_at"]
    for batch in batches:
        if batch.column("h").null_count:
            yield batch.filter(batch.column("h").is_null()).select(names)
        marked = "context" in batch.schema.names
        batch = batch.filter(batch.column("h").is_valid()).select(["h", "doc_id", "at", *["context"] * marked])
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
        h = table.column("h").to_numpy()
        lead = np.ones(len(h), dtype=bool)
        lead[1:] = h[1:] != h[:-1]
        leader = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
        matched = ~lead
        if not marked:
            matched &= table.column("at").to_numpy() & UNLIKE == 0
        at = np.flatnonzero(matched)
        own, first = table.take(pa.array(at)), table.take(pa.array(leader[at]))
        columns = [x.column(c).combine_chunks() for x in (own, first) for c in ("doc_id", "at")]
        if marked:
            around = [x.column("context").to_numpy().view(np.uint64) for x in (own, first)]
            columns[1] = pa.array(columns[1].to_numpy() | np.where(unlike_contexts(*around), UNLIKE, 0))
        out = pa.Table.from_arrays(columns, names=names)
        carry = table.slice(int(leader[-1]), 1).to_batches()[0]
        yield from out.to_batches()


def merge_diagonals(pair: np.ndarray, d: np.ndarray, r: np.ndarray, kmer: int, reach: int, unlike: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks (pair, start, start in the other, words, all contexts unlike) of a pair's matches on one diagonal that lie within ``reach``."""
    order = np.lexsort((d, d - r, pair))
    pair, d, r, unlike = pair[order], d[order], r[order], unlike[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (d[1:] - r[1:] != d[:-1] - r[:-1]) | (d[1:] - d[:-1] > reach)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return pair[first], d[first], r[first], d[last] + kmer - d[first], np.logical_and.reduceat(unlike, first)


def chains_of(d: np.ndarray, r: np.ndarray, n: np.ndarray, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Best collinear chains of blocks, each block in one chain at most.

    The score of a chain is its words less ``gap_cost`` for each word of gap. The cost is linear, so the best
    predecessor is a prefix maximum over ends in the other document: a Fenwick tree answers it.
    """
    order = np.lexsort((r, d))
    ends = np.sort(np.unique(r + n))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    score, before = [0.0] * len(d), [-1] * len(d)
    waiting = sorted((int(d[i] + n[i]), int(i)) for i in range(len(d)))  # blocks enter the tree when they end
    entered = 0
    end_list = ends.tolist()
    for i in order.tolist():
        while entered < len(waiting) and waiting[entered][0] <= d[i]:
            j = waiting[entered][1]
            value, at = (score[j] + gap_cost * (int(d[j] + n[j]) + int(r[j] + n[j])), j), bisect_left(end_list, int(r[j] + n[j])) + 1
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
            entered += 1
        at, best = bisect_left(end_list, int(r[i]) + 1), (-np.inf, -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - gap_cost * (int(d[i]) + int(r[i]))
        score[i] = float(n[i]) + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
    used, out = [False] * len(d), []
    for i in sorted(range(len(d)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            if chain and max(d[chain[-1]] - d[i] - n[i], r[chain[-1]] - r[i] - n[i]) > MAX_GAP:
                out.append(chain[::-1])
                chain = []
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def first_wave(intervals: list[tuple[int, int, int]]) -> list[bool]:
    """Of a document's chains (start, end, score), the best ones that do not lie half or more in better ones."""
    taken: list[tuple[int, int]] = []  # disjoint, sorted
    out = [False] * len(intervals)
    for i in sorted(range(len(intervals)), key=lambda i: (-intervals[i][2], i)):
        lo, hi, _ = intervals[i]
        at = bisect_left(taken, (lo, lo))
        at -= at > 0 and taken[at - 1][1] > lo
        upto, inside = at, 0
        while upto < len(taken) and taken[upto][0] < hi:
            inside += min(hi, taken[upto][1]) - max(lo, taken[upto][0])
            upto += 1
        if 2 * inside < hi - lo:
            out[i] = True
            near = [(lo, hi), *taken[at:upto]]
            taken[at:upto] = [(min(a for a, _ in near), max(b for _, b in near))]
    return out


_STRETCH = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def stretches_of(doc: np.ndarray, pos: np.ndarray, kmer: int, min_words: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (document, start, end) that the matches of documents cover, whatever documents they lead to, and that may hold a passage.

    A passage begins and ends up to ``slack`` words beyond its seeds, and longer keys need two of these.
    """
    doc, pos = np.divmod(np.unique((doc << 32) + pos), 1 << 32)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > kmer + FLANK // 2)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    lo, hi = pos[first], pos[last] + kmer
    kept = (hi - lo + 2 * slack >= min_words) & ((last > first) | (hi - lo > 2 * KMER))
    return doc[first][kept], np.maximum(0, lo - slack)[kept], (hi + slack)[kept]


_BLOCKS = pa.list_(pa.struct([("d", pa.int32()), ("r", pa.int32()), ("n", pa.int32())]))
_CHAIN = pa.schema([("doc_id", pa.int64()), ("salt", pa.int32()), ("chains", pa.list_(pa.struct(
    [("r_doc", pa.int64()), ("r_salt", pa.int32()), ("blocks", _BLOCKS), ("best", pa.bool_())]))), ("tiles", pa.list_(pa.int32())), ("stretches", _STRETCH)])
_CHAIN_DDL = ("doc_id bigint, salt int, chains array<struct<r_doc:bigint,r_salt:int,blocks:array<struct<d:int,r:int,n:int>>,"
              "best:boolean>>, tiles array<int>, stretches array<struct<start:int,end:int>>")


def tiles_of(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tiles that the words of each owner from ``start`` to ``end`` and their flanks lie in: (owner, tile), sorted, each once."""
    first = np.maximum(0, start - FLANK) // TILE
    n = (end + FLANK) // TILE + 1 - first
    tile = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
    return np.divmod(np.unique((np.repeat(owner, n) << 32) + tile), 1 << 32)


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """A list for each of ``n`` owners of the values, which are sorted by ``owner``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Rows that differ from the row before in one of the columns, nulls being equal."""
    new = np.zeros(table.num_rows, dtype=bool)
    for name in names:
        column = table.column(name).combine_chunks()
        value, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return new


def _chain(kmer: int, window: int, min_words: int):
    """Matches sorted by (document, other document) to one row of chains per document, whose matches are held at a time.

    A chain of one or two seeds whose contexts are unlike is no passage by itself: it is left out, and counts in the
    stretches for longer keys only. Rows without chains name the tiles that the chains of a batch need of an earlier
    document, each once.
    """
    slack = 2 * (kmer + window)

    def finish(table: pa.Table) -> pa.RecordBatch:
        pos, other = table.column("pos").to_numpy().astype(np.int64), table.column("r_pos").to_numpy().astype(np.int64)
        fresh = _changes(table, ("doc_id", "salt"))
        moved = fresh | _changes(table, ("r_doc", "r_salt"))
        moved[0] = fresh[0] = True
        heads, pairs = np.flatnonzero(fresh), np.flatnonzero(moved)
        doc_of = (np.cumsum(fresh) - 1)[pairs]  # of each pair
        pair, d, r, n, weak = merge_diagonals(np.cumsum(moved) - 1, pos, other, kmer, kmer + window, table.column("unlike").to_numpy())
        weak = weak & (n <= 2 * kmer)
        begin = np.searchsorted(pair, np.arange(len(pairs) + 1))
        alone = np.diff(begin) == 1
        lone = np.flatnonzero(alone)
        lone = lone[~weak[begin[lone]]]
        owner, sizes, members = [], [], []
        for k in np.flatnonzero(~alone).tolist():
            lo, hi = begin[k], begin[k + 1]
            for chain in chains_of(d[lo:hi], r[lo:hi], n[lo:hi]):
                if len(chain) > 1 or not weak[lo + chain[0]]:
                    owner.append(k)
                    sizes.append(len(chain))
                    members += [lo + x for x in chain]
        # chains (pair, blocks), sorted by pair
        owner, sizes = np.concatenate([lone, np.array(owner, np.int64)]), np.concatenate([np.ones(len(lone), np.int64), np.array(sizes, np.int64)])
        members, before = np.concatenate([begin[lone], np.array(members, np.int64)]), np.cumsum(sizes) - sizes
        order = np.argsort(owner, kind="stable")
        owner, sizes, before = owner[order], sizes[order], before[order]
        first = np.cumsum(sizes) - sizes
        members = members[np.arange(len(members)) + np.repeat(before - first, sizes)]
        head, tail = members[first], members[first + sizes - 1]
        doc, start, end = doc_of[owner], d[head], d[tail] + n[tail]
        best = np.ones(len(owner), dtype=bool)
        if len(owner):
            bounds, score = np.searchsorted(doc, np.arange(len(heads) + 1)), np.add.reduceat(n[members], first)
            for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
                some = slice(bounds[k], bounds[k + 1])
                best[some] = first_wave(list(zip(start[some].tolist(), end[some].tolist(), score[some].tolist())))
        reach, lo, hi = stretches_of((np.cumsum(fresh) - 1), pos, kmer, min_words, slack)
        asked, tile = tiles_of(np.concatenate([doc, reach]), np.concatenate([start, lo]), np.concatenate([end, hi]))
        # each earlier document once
        others = table.select(["r_doc", "r_salt"]).take(pa.array(pairs[owner])).combine_chunks()
        known, salt = others.column("r_doc").is_valid().to_numpy(), others.column("r_salt").to_numpy()
        number = others.column("r_doc").fill_null(0).to_numpy()
        order = np.lexsort((salt, number, known))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (salt[order][1:] != salt[order][:-1]) | (number[order][1:] != number[order][:-1]) | (known[order][1:] != known[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        far = others.take(pa.array(order[new]))
        wanted, far_tile = tiles_of(which, r[head], r[tail] + n[tail])
        struct = lambda names, *columns: pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for x in columns], names)
        one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        blocks = _lists(np.repeat(np.arange(len(owner)), sizes), len(owner), struct(["d", "r", "n"], d[members], r[members], n[members]))
        chains = struct(["r_doc", "r_salt", "blocks", "best"], one(others, "r_doc"), one(others, "r_salt"), blocks, pa.array(best))
        rows = table.select(["doc_id", "salt"]).take(pa.array(heads))
        none = lambda kind: pa.nulls(far.num_rows, kind)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([one(rows, "doc_id"), one(far, "r_doc")]), pa.concat_arrays([one(rows, "salt"), one(far, "r_salt")]),
            pa.concat_arrays([_lists(doc, len(heads), chains).cast(_CHAIN.field(2).type), none(_CHAIN.field(2).type)]),
            pa.concat_arrays([_lists(asked, len(heads), pa.array(tile, pa.int32())), _lists(wanted, far.num_rows, pa.array(far_tile, pa.int32()))]).cast(_CHAIN.field(3).type),
            pa.concat_arrays([_lists(reach, len(heads), struct(["start", "end"], lo, hi)).cast(_STRETCH), none(_STRETCH)])], schema=_CHAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            cuts = np.flatnonzero(_changes(table, ("doc_id", "salt")))
            if len(cuts):
                yield finish(table.slice(0, int(cuts[-1])))
                table = table.slice(int(cuts[-1]))
            rest = table
        if rest is not None:
            yield finish(rest)

    return run


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of a list column."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _tile_words(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    counts, tiles, asked = np.zeros(len(texts), np.int64), [], wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    parent, out = _owners(wanted), []
    for words in word_groups(texts, hashed=False):
        size = words.end - words.start
        # the bytes of all words, a space after each
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        inside = IN_WORD[words.lower]
        joined[np.arange(len(joined) - len(size)) + np.repeat(np.arange(len(size)), size)] = words.lower[inside]
        at, held, bounds = np.concatenate([[0], np.cumsum(size + 1)]), joined.tobytes(), words.bounds()
        some = slice(*np.searchsorted(parent, [words.first_row, words.first_row + words.n_rows]))
        row, tile = parent[some] - words.first_row, asked[some]
        first = bounds[row] + tile * TILE
        real = (tile >= 0) & (first < bounds[row + 1])
        row, tile, first = row[real], tile[real], first[real]
        upto = np.minimum(first + TILE, bounds[row + 1])
        counts[words.first_row:words.first_row + words.n_rows] = np.bincount(row, minlength=words.n_rows)
        tiles.append(tile)
        out += [held[a:b].decode("utf-8", "replace") for a, b in zip(at[first].tolist(), (at[upto] - 1).tolist())]
    tiles = pa.array(np.concatenate([np.zeros(0, np.int64), *tiles]), pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                    pa.StructArray.from_arrays([tiles, pa.array(out, pa.string())], ["tile", "words"]))


def _extend(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, b_words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ways to go on in the rows of ``a`` and ``b`` (numbers of words, the first ``a_words`` and ``b_words`` of a row).

    (row, words of a, words of b, equal ones among them), sorted by the first two, each way ending on an equal word; a row's
    first way has none. For each number of words of ``a`` the one with the most equal words for its length is kept. An equal
    word scores 1, another, missing or added one -1, and the search ends where all scores are ``X_DROP`` below the best.
    All rows of ``a`` and ``b`` go on together, a word of ``a`` at a time.
    """
    low, step, drop = -(1 << 29), 1 << 12, X_DROP << 12  # the low bits of a score count equal words
    wide = b.shape[1]
    cost = np.arange(wide + 1, dtype=np.int32) * np.int32(step)
    line = np.where(np.arange(wide + 1) <= np.minimum(b_words, X_DROP)[:, None], -cost, np.int32(low)).astype(np.int32)
    which, top = np.arange(len(a)), np.zeros(len(a), np.int32)
    none = np.zeros(len(a), np.int64)
    out, lo, hi = [(which, none, none, none)], 0, min(wide, X_DROP)
    for i in range(1, a.shape[1] + 1):
        still = a_words[which] >= i
        if not still.all():
            which, top, line = which[still], top[still], line[still]
        if not len(which):
            break
        # no score is held outside lo to hi; from there at most X_DROP added words follow a next one
        end = min(wide, hi + X_DROP + 1)
        old, spent = line[:, lo:end + 1], cost[lo:end + 1]
        same = a[which, i - 1][:, None] == b[which, lo:end]
        slope = old[:, :-1] + np.where(same, np.int32(step + 1), np.int32(-step))
        score = old - np.int32(step)
        np.maximum(score[:, 1:], slope, out=score[:, 1:])
        score = np.maximum.accumulate(score + spent, axis=1) - spent
        score[np.arange(lo, end + 1) > b_words[which][:, None]] = low
        best = np.where(same & (score[:, 1:] == slope), slope, np.int32(low))
        highest = np.maximum(np.maximum.accumulate(score, axis=1), top[:, None])
        held = score >= highest - np.int32(drop)
        top = highest[:, -1]
        alive = held.any(axis=1)
        place = best.argmax(axis=1) if end > lo else np.zeros(len(which), np.int64)
        value = best[np.arange(len(which)), place] if end > lo else np.full(len(which), low, np.int32)
        found = np.flatnonzero(alive & (value >= top - drop))
        out.append((which[found], np.full(len(found), i), place[found] + lo + 1, value[found].astype(np.int64) & (step - 1)))
        columns = np.flatnonzero(held.any(axis=0))
        if not len(columns):
            break
        line = np.full((int(alive.sum()), wide + 1), low, np.int32)
        line[:, lo:end + 1] = np.where(held, score, np.int32(low))[alive]
        which, top = which[alive], top[alive]
        lo, hi = int(columns[0]) + lo, int(columns[-1]) + lo
    out = [np.concatenate(x) for x in zip(*out)]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def _flanks(codes: np.ndarray, first: np.ndarray, words: np.ndarray, back: bool) -> np.ndarray:
    """A row of the words that follow ``first``, or go back from it, for each; -1 beyond ``words``."""
    k = np.arange(FLANK)
    at = first[:, None] - k if back else first[:, None] + k
    inside = k < words[:, None]
    return np.where(inside, codes[np.where(inside, at, 0)], -1) if len(codes) else np.full(at.shape, -1)


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence: a bit for each word of ``a``, unset where the length grows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for y in b:
        same = row & places.get(y, 0)
        row = (row + same | row - same) & whole
    return len(a) - row.bit_count()


def _best_end(ways: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The way with the best score if unequal words cost 2."""
    return max(ways, key=lambda w: (3 * w[2] - 2 * max(w[0], w[1]), -w[0]))


def _further(ways: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ways no longer than the best one, and longer ones of whose further words at least half are equal."""
    i, j, same = _best_end(ways)
    return [w for w in ways if w[0] <= i or 2 * (w[2] - same) >= max(w[0], w[1]) - max(i, j)]


def align(blocks: list[dict], a: list, a_first: int, b: list, b_first: int, min_words: int = MIN_WORDS,
          identity: float = IDENTITY) -> tuple[int, int, int, int, int]:
    """(start, end, start in the other, end in the other, equal words) of one chain, extended at its ends.

    ``a`` and ``b`` hold the words of the two documents from ``a_first`` and ``b_first``.
    """
    number: dict = {}
    codes = np.array([number.setdefault(x, len(number)) for x in [*a, *b]], np.int64)
    one = lambda x: np.array([x], np.int64)
    parts = [[one(x[c]) for x in (blocks[0], blocks[-1])] for c in ("d", "r", "n")]
    left, right = _both_ends(codes, one(0), one(len(a)), one(a_first), one(len(a)), one(len(codes)), one(b_first), *parts)
    ways = [list(zip(*(x.tolist() for x in side[1:]))) for side in (left, right)]
    return _placed(blocks, codes[:len(a)].tolist(), a_first, codes[len(a):].tolist(), b_first, *ways, min_words, identity)


def _both_ends(codes: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, a_first: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, b_first: np.ndarray,
               d: list[np.ndarray], r: list[np.ndarray], n: list[np.ndarray]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Ways (as of ``_extend``) before the first and after the last block of each chain.

    A chain's words are ``codes[a_lo:a_hi]`` and ``codes[b_lo:b_hi]``, from words ``a_first`` and ``b_first`` of the documents;
    ``d``, ``r`` and ``n`` hold the first blocks and the last ones.
    """
    sides = []
    for back in (True, False):
        flanks = []
        for lo, hi, first, place in ((a_lo, a_hi, a_first, d), (b_lo, b_hi, b_first, r)):
            at = lo - first + (place[0] if back else place[1] + n[1])
            words = np.minimum(at - lo, FLANK) - np.maximum(at - hi, 0) if back else np.minimum(hi - at, FLANK)
            words = np.maximum(words, 0)
            flanks += [_flanks(codes, np.minimum(at, hi) - 1 if back else at, words, back), words]
        sides.append(_extend(*flanks))
    return tuple(sides)


def _placed(blocks: list[dict], a: list, a_first: int, b: list, b_first: int, left: list[tuple[int, int, int]],
            right: list[tuple[int, int, int]], min_words: int, identity: float) -> tuple[int, int, int, int, int]:
    """A chain's place, given the ways to go on at its ends.

    The ends are those with the best scores. If the chain is too short or too unlike then, every start and end (of its blocks
    and beyond) is tried, and of the stretches that are a passage the one with the most equal words above ``identity`` is returned.
    """
    equal_run = lambda d, r, n: sum(x == y for x, y in zip(a[d - a_first:d - a_first + n], b[r - b_first:r - b_first + n]))
    starts, ends, same = [], [], 0
    for k, x in enumerate(blocks):
        if k:
            y = blocks[k - 1]
            d, r = y["d"] + y["n"], y["r"] + y["n"]
            same += _common(a[d - a_first:x["d"] - a_first], b[r - b_first:x["r"] - b_first])
        starts.append((x["d"], x["r"], same))
        same += equal_run(x["d"], x["r"], x["n"])
        ends.append((x["d"] + x["n"], x["r"] + x["n"], same))
    (start, other, _), (end, other_end, _) = starts[0], ends[-1]
    (i, j, more), (u, v, also) = _best_end(left), _best_end(right)
    whole = start - i, end + u, other - j, other_end + v, same + more + also
    if _is_passage(*whole, min_words, identity):
        return whole
    starts += [(start - i, other - j, -more) for i, j, more in _further(left)]
    ends += [(end + i, other_end + j, same + more) for i, j, more in _further(right)]
    x, y = np.array(starts)[:, None, :], np.array(ends)[None, :, :]
    span, far, equal = (y - x).transpose(2, 0, 1)
    surplus = equal - identity * np.maximum(span, far)
    surplus[(span < min_words) | (far <= 0) | (surplus < 0)] = -1
    at = np.unravel_index(surplus.argmax(), surplus.shape)
    if surplus[at] < 0:
        return whole
    (s, o, before), (e, oe, upto) = starts[at[0]], ends[at[1]]
    return s, e, o, oe, upto - before


def _is_passage(start: int, end: int, other: int, other_end: int, same: int, min_words: int, identity: float) -> bool:
    return end - start >= min_words and same >= identity * max(end - start, other_end - other)


_PASSAGE = pa.schema([("doc_id", pa.int64()), ("salt", pa.int32()), ("start_word", pa.int32()), ("n_words", pa.int32()),
                      ("match_doc_id", pa.int64()), ("match_salt", pa.int32()), ("match_start_word", pa.int32()), ("equal_words", pa.int32())])
_PASSAGE_DDL = ("doc_id bigint, salt int, start_word int, n_words int, match_doc_id bigint, match_salt int, "
                "match_start_word int, equal_words int")


def _align_all(min_words: int, identity: float):
    """Rows sorted by (cid, side, tile), first a chain's own row (side -1), then its tiles; the chains of a batch are held at a time."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        side = table.column("side").to_numpy()
        heads, body = table.filter(pa.array(side < 0)), table.filter(pa.array(side >= 0))
        number = (np.cumsum(side < 0) - 1)[side >= 0] * 2 + side[side >= 0]
        tile = np.append(body.column("tile").to_numpy(), 0).astype(np.int64)
        split = pc.split_pattern(body.column("words").combine_chunks(), " ")
        at, codes = split.offsets.to_numpy(), split.flatten().dictionary_encode().indices.to_numpy()
        at = (at - at[0]).astype(np.int64)
        bounds = np.searchsorted(number, np.arange(2 * heads.num_rows + 1))
        # words of both sides of each chain, and the place of the first one in its document
        (a_lo, b_lo), (a_hi, b_hi) = at[bounds[:-1]].reshape(-1, 2).T, at[bounds[1:]].reshape(-1, 2).T
        a_first, b_first = (tile[bounds[:-1]] * TILE).reshape(-1, 2).T
        lists = heads.column("blocks").combine_chunks()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        parts = [lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("d", "r", "n")]
        d, r, n = ([x[first[:-1]], x[first[1:] - 1]] for x in parts)
        left, right = _both_ends(codes, a_lo, a_hi, a_first, b_lo, b_hi, b_first, d, r, n)
        reach = [[np.maximum.reduceat(x, np.searchsorted(way[0], np.arange(heads.num_rows))) for x in (way[1], way[3])] for way in (left, right)]
        span, far = d[1] + n[1] - d[0], r[1] + n[1] - r[0]
        # no other chain can have enough words, or enough equal ones
        able = (span + reach[0][0] + reach[1][0] >= min_words) & (np.minimum(span, far) + reach[0][1] + reach[1][1] >= identity * min_words)
        out, kept = [], np.flatnonzero(able & (a_lo < a_hi) & (b_lo < b_hi))
        ways = [(np.searchsorted(way[0], np.arange(heads.num_rows + 1)), way) for way in (left, right)]
        for k in kept.tolist():
            blocks = [dict(zip("drn", x)) for x in zip(*(x[first[k]:first[k + 1]].tolist() for x in parts))]
            on = [list(zip(*(x[cut[k]:cut[k + 1]].tolist() for x in way[1:]))) for cut, way in ways]
            a, b = codes[a_lo[k]:a_hi[k]].tolist(), codes[b_lo[k]:b_hi[k]].tolist()
            s, e, o, oe, same = _placed(blocks, a, int(a_first[k]), b, int(b_first[k]), *on, min_words, identity)
            if _is_passage(s, e, o, oe, same, min_words, identity):
                out.append((k, s, e - s, o, same))
        k, s, words, o, same = zip(*out) if out else [()] * 5
        own = heads.select(["doc_id", "salt", "r_doc", "r_salt"]).take(pa.array(k, pa.int64())).combine_chunks()
        doc, salt, other, other_salt = (c.combine_chunks() for c in own.columns)
        return pa.RecordBatch.from_arrays([doc, salt, pa.array(s, pa.int32()), pa.array(words, pa.int32()), other, other_salt,
                                           pa.array(o, pa.int32()), pa.array(same, pa.int32())], schema=_PASSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            heads = np.flatnonzero(batch.column(batch.schema.get_field_index("side")).to_numpy() < 0)
            rest.append(batch)
            if len(heads):
                if len(rest) > 1 or heads[-1]:
                    yield finish(pa.Table.from_batches([*rest[:-1], batch.slice(0, int(heads[-1]))]))
                rest = [batch.slice(int(heads[-1]))]
        if any(batch.num_rows for batch in rest):
            yield finish(pa.Table.from_batches(rest))

    return run


def _same_doc(a: str, a_salt: str, b: str, b_salt: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(a_salt) == F.col(b_salt))


def open_or_first(keys: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (h, doc_id, at) without owners that cannot be the first of their key, because another row here comes before them."""
    ids = keys.column(1)
    known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    h, at = keys.column(0).to_numpy(), keys.column(2).to_numpy()
    order = np.lexsort((at, number, known, h))
    kept = np.ones(len(order), dtype=bool)
    kept[1:] = (h[order][1:] != h[order][:-1]) | (at[order][1:] & UNLIKE == 0)
    return keys.take(pa.array(order[kept]))


def _longer_keys(min_words: int, kmer: int, window: int):
    """(doc_id, salt, tiles, stretches, spans) to keys of several seeds: two, four and eight in a row, and ``min_words`` words from a seed.

    The first document with a key of ``min_words`` words has that passage whole. A place inside a span that is found
    already counts as an owner only: bit 31 of it is set. Of the owners of a key, ``KEYS_HELD`` rows or a batch pass on
    the first one, so a passage of many documents is not a row of each.
    """
    names = ["h", "doc_id", "at"]

    def passed_on(keys: list, ids: list, places: list) -> pa.RecordBatch:
        return open_or_first(pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays(ids), pa.array(np.concatenate(places))], names=names))

    def grouped(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        """(rows, tiles) of about ``GROUP_BYTES`` of words; every row is in one group."""
        size = pc.list_value_length(batch.column("tiles")).to_numpy(zero_copy_only=False).astype(np.int64)
        tiles = batch.column("tiles").flatten()
        words = pc.binary_length(tiles.field("words")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        used = np.concatenate([[0], np.cumsum(words)])[ends]
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, int(np.searchsorted(used, used[row] + GROUP_BYTES, "right")) - 1)
            yield batch.slice(row, upto - row), tiles.slice(int(ends[row]), int(ends[upto] - ends[row]))
            row = upto

    def within(row: np.ndarray, at: np.ndarray, lists: pa.ListArray, ends: str | None) -> np.ndarray:
        """Whether the k-mer at a place of a row lies in one of the row's spans (start and ``end``, or start and words)."""
        owner, spans = _owners(lists), lists.flatten()
        start = spans.field("start" if ends else "start_word").to_numpy(zero_copy_only=False).astype(np.int64)
        end = spans.field(ends).to_numpy(zero_copy_only=False).astype(np.int64) if ends else start + spans.field("n_words").to_numpy(zero_copy_only=False)
        if not len(start):
            return np.zeros(len(at), dtype=bool)
        order = np.lexsort((start, owner))
        start, furthest = ((owner << 32) + start)[order], np.maximum.accumulate(((owner << 32) + end)[order])
        before = np.searchsorted(start, (row << 32) + at, "right") - 1
        return (before >= 0) & (furthest[before] >= (row << 32) + at + kmer)

    def keys_of(rows: pa.RecordBatch, tiles: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, row, place) of the longer keys inside the stretches of some rows."""
        owner = _owners(rows.column("tiles"))
        tile = tiles.field("tile").to_numpy(zero_copy_only=False).astype(np.int64)
        # rows equal in id and text give the same tiles
        order = np.lexsort((tile, owner))
        owner, tile = owner[order], tile[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (tile[1:] != tile[:-1])
        order, owner, tile = order[new], owner[new], tile[new]
        # neighbouring tiles are one piece
        first = np.ones(len(order), dtype=bool)
        first[1:] = (owner[1:] != owner[:-1]) | (tile[1:] != tile[:-1] + 1)
        piece = np.cumsum(first) - 1
        out = []
        for words in word_groups(tiles.field("words").take(pa.array(order)), sys.maxsize):
            words.row = piece[words.row]
            short, at = window_hashes(words, kmer)
            seeds = minimisers(short, words.row[at], window)
            value, pos = short[seeds], at[seeds]
            whole, begin = window_hashes(words, min_words)
            where = np.searchsorted(begin, pos)
            has = np.append(begin, -1)[where] == pos
            found = [(mix(whole[where[has]] ^ np.uint64(0x5DEECE66D)), pos[has])]
            for n in (2, 4, 8):
                total = np.full(max(0, len(value) - n + 1), n, np.uint64)
                for j in range(n):
                    total = mix(total * np.uint64(31) + value[j:j + len(total)])
                one = words.row[pos[:len(total)]] == words.row[pos[n - 1:n - 1 + len(total)]]
                found.append((total[one], pos[:len(total)][one]))
            h, pos = (np.concatenate(x) for x in zip(*found))
            heads = np.flatnonzero(first)
            at = pos - np.searchsorted(words.row, words.row[pos]) + tile[heads][words.row[pos]] * TILE
            row = owner[heads][words.row[pos]]
            inside = within(row, at, rows.column("stretches"), "end")
            h, row, at = h[inside], row[inside], at[inside]
            covered = within(row, at, rows.column("spans"), None)
            out.append((h.view(np.int64), row, np.where(covered, at | UNLIKE, at)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, places, held = [], [], [], 0
        for batch in batches:
            if held >= KEYS_HELD:
                yield passed_on(keys, ids, places)
                keys, ids, places, held = [], [], [], 0
            for rows, tiles in grouped(batch):
                h, row, at = keys_of(rows, tiles)
                keys.append(h)
                places.append(rows.column("salt").to_numpy().astype(np.int64)[row] << 32 | at)
                ids.append(rows.column("doc_id").take(pa.array(row)))
                held += len(h)
        if keys:
            yield passed_on(keys, ids, places)

    return run


def _by_document(matches: DataFrame) -> DataFrame:
    """Matches dealt by document; the first row of a seed may be a later place of the same document, which is left out."""
    salt = lambda c: F.shiftright(c, 32)
    other = ~(F.col("doc_id").eqNullSafe(F.col("r_doc")) & (salt("at") == salt("r_at")))
    return matches.where(other).repartition("doc_id", salt("at"))


def _all_chains(docs: DataFrame, kmer: int, window: int, min_words: int) -> DataFrame:
    """Written chains of every document's matches, and the tiles they need."""
    seeds = docs.mapInArrow(lean(_seeds(kmer, window)), _SEED_DDL)
    mark = F.when(F.col("h").isNull() & F.col("unlike"), F.lit(UNLIKE)).otherwise(F.lit(0)).cast("long")
    # narrow rows, dealt once and not written: those matched in their batch go along to the task of their document
    seeds = seeds.select("h", "doc_id", _packed("salt", "pos").bitwiseOR(mark).alias("at"), "r_doc", _packed("r_salt", "r_pos").alias("r_at"), "context")
    dealt = seeds.repartition(F.coalesce("h", F.xxhash64("doc_id", "at"))).sortWithinPartitions("h", "doc_id", "at")
    matches = _unpacked(_by_document(dealt.mapInArrow(lean(_match_firsts), _PLACES)))
    dealt = matches.sortWithinPartitions(*_KEY, "r_doc", "r_salt", "pos", "r_pos")
    return materialize(dealt.mapInArrow(lean(_chain(kmer, window, min_words)), _CHAIN_DDL), "chains")


def _all_tiles(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """Written tiles (w_doc, w_salt, w_tile, words), each once for all chains: the texts are dealt once.

    Rows equal in id and text give the same tiles; they are one here, so that no reader deals the tiles for that.
    """
    wanted = chains.select(*_KEY, F.explode("tiles").alias("tile")).groupBy(*_KEY, "tile").agg(F.lit(1))
    wanted = wanted.groupBy(*_KEY).agg(F.collect_list("tile").alias("tiles")).withColumnsRenamed({"doc_id": "w_doc", "salt": "w_salt"})
    # dealt alike at every size
    held = docs.join(wanted.hint("merge"), _same_doc("doc_id", "salt", "w_doc", "w_salt"))
    cut = F.arrow_udf(lean(_tile_words), "array<struct<tile:int,words:string>>")
    held = held.select("w_doc", "w_salt", F.explode(cut("text", "tiles")).alias("t")).select(
        "w_doc", "w_salt", F.col("t.tile").alias("w_tile"), F.col("t.words").alias("words"))
    return materialize(held.dropDuplicates(["w_doc", "w_salt", "w_tile"]), "tiles")


def _aligned(some: DataFrame, held: DataFrame, min_words: int, identity: float, label: str) -> DataFrame:
    """Written passages of the chains of ``some`` (a row per document) with the words of ``held``."""
    single = some.select(*_KEY, F.explode("chains").alias("c")).select(*_KEY, "c.r_doc", "c.r_salt", "c.blocks")
    single = materialize(single.withColumn("cid", F.monotonically_increasing_id()), "single")
    filled = _pieces(single).join(held, _same_doc("doc_id", "salt", "w_doc", "w_salt") & (F.col("tile") == F.col("w_tile")))
    heads = single.select("cid", F.lit(-1).alias("side"), F.lit(0).alias("tile"), F.lit("").alias("words"), *_KEY, "r_doc", "r_salt", "blocks")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in heads.schema.fields[4:]]
    filled = heads.union(filled.select("cid", "side", "tile", "words", *none))
    dealt = filled.repartition("cid").sortWithinPartitions("cid", "side", "tile")
    out = materialize(dealt.mapInArrow(lean(_align_all(min_words, identity)), _PASSAGE_DDL), label)
    discard(single)
    return out


def _with_spans(some: DataFrame, found: DataFrame) -> DataFrame:
    spans = found.groupBy(*_KEY).agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "s_doc", "salt": "s_salt"})
    more = some.join(spans, _same_doc("doc_id", "salt", "s_doc", "s_salt"), "left").drop("s_doc", "s_salt")
    return more.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start_word:int,n_words:int>>")))


def _longer_chains(chains: DataFrame, found: DataFrame, held: DataFrame, min_words: int, kmer: int, window: int) -> DataFrame:
    """Written chains of longer keys, of stretches where every seed has an earlier owner but no two owners the same."""
    wide = _with_spans(chains.where(F.size("stretches") > 0).drop("chains"), found)
    # the tiles are dealt once, with the stretches of their document
    tile = F.struct(F.col("w_tile").alias("tile"), "words")
    parts = held.select(F.col("w_doc").alias("doc_id"), F.col("w_salt").alias("salt"), tile.alias("tile"), *[
        F.lit(None).cast(wide.schema[c].dataType).alias(c) for c in ("stretches", "spans")])
    parts = parts.union(wide.select(*_KEY, F.lit(None).cast(parts.schema["tile"].dataType).alias("tile"), "stretches", "spans"))
    wide = parts.groupBy(*_KEY).agg(F.collect_list("tile").alias("tiles"), *[F.first(c, True).alias(c) for c in ("stretches", "spans")])
    wide = wide.where(F.col("stretches").isNotNull())
    keys = wide.mapInArrow(lean(_longer_keys(min_words, kmer, window)), "h bigint, doc_id bigint, at bigint")
    # a covered place has bit 31 set, so that it sorts after open ones of the document
    keys = keys.repartition("h").sortWithinPartitions("h", "doc_id", "at")
    links = _by_document(keys.mapInArrow(lean(_match_firsts), _PLACES))
    links = _unpacked(links.withColumn("r_at", F.col("r_at").bitwiseAND(F.lit(~(1 << 31)))))
    links = links.sortWithinPartitions(*_KEY, "r_doc", "r_salt", "pos", "r_pos")
    return materialize(links.mapInArrow(lean(_chain(kmer, window, min_words)), _CHAIN_DDL).where("chains is not null").drop("tiles", "stretches"), "further-chains")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                      identity: float = IDENTITY, kmer: int = KMER, window: int = WINDOW) -> DataFrame:
    """One row per passage of a document that an earlier document has: places in words, the earlier document, equal words.

    Works in waves; what a wave has dealt is let go before the next one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), _salt(text_col).alias("salt"), F.col(text_col).alias("text"))
    with shuffles_dropped(docs.sparkSession):
        return _in_waves(docs, min_words, identity, kmer, window)


def _in_waves(docs: DataFrame, min_words: int, identity: float, kmer: int, window: int) -> DataFrame:
    all_chains = _all_chains(docs, kmer, window, min_words)
    tiles = _all_tiles(docs, all_chains)
    chains = all_chains.where("chains is not null").drop("tiles")
    found = _aligned(chains.withColumn("chains", F.filter("chains", lambda c: c["best"])), tiles, min_words, identity, "passages")

    def open_still(c: Column) -> Column:
        first, last = c["blocks"][0], F.element_at(c["blocks"], -1)
        return ~c["best"] & ~F.exists("spans", lambda s: (s["start_word"] <= first["d"]) & (
            last["d"] + last["n"] <= s["start_word"] + s["n_words"]))

    more = _with_spans(chains, found)
    more = materialize(more.withColumn("chains", F.filter("chains", open_still)).where(F.size("chains") > 0).select(*_KEY, "chains"), "others")
    also = _aligned(more, tiles, min_words, identity, "further-passages")
    discard(more)
    again = _longer_chains(chains, found.union(also), tiles, min_words, kmer, window)
    third = _aligned(again, tiles, min_words, identity, "longer-passages")
    discard(all_chains, tiles, again)
    return found.union(also).union(third)


def _pieces(chains: DataFrame) -> DataFrame:
    """(cid, side, doc_id, salt, tile): what a chain needs of its document (side 0) and of the other one."""

    def tiles(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(F.lit(0), start - FLANK) / TILE).cast("int"), F.floor((end + FLANK) / TILE).cast("int")))

    first, last = F.col("blocks")[0], F.element_at("blocks", -1)
    own = chains.select("cid", F.lit(0).alias("side"), "doc_id", "salt", tiles(first["d"], last["d"] + last["n"]).alias("tile"))
    other = chains.select("cid", F.lit(1).alias("side"), F.col("r_doc").alias("doc_id"), F.col("r_salt").alias("salt"),
                          tiles(first["r"], last["r"] + last["n"]).alias("tile"))
    return own.union(other)


def _cut_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the words of its spans and what stands between them."""
    out, asked, held = [], spans.to_pylist(), texts.to_pylist()
    for words in word_groups(texts):
        bounds = words.bounds().tolist()
        for r in range(words.n_rows):
            at = words.first_row + r
            if not asked[at]:
                out.append(held[at])
                continue
            lo, hi, base = bounds[r], bounds[r + 1], int(words.text_start[r])
            raw, parts, done = held[at].encode(), [], 0
            for s in sorted(asked[at], key=lambda s: s["start_word"]):
                start, end = lo + s["start_word"], min(hi, lo + s["start_word"] + s["n_words"])
                a, b = int(words.start[start]) - base, int(words.end[end - 1]) - base
                parts.append(raw[done:max(done, a)])
                done = max(done, b)
            out.append(b"".join([*parts, raw[done:]]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def _has_word(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with repeated passages cut out of later documents; a document that loses all its words goes."""
    found = repeated_passages(docs, id_col, text_col, **kwargs)
    # spans of one place from several earlier documents are one
    spans = found.groupBy("doc_id", "salt").agg(F.collect_set(F.struct("start_word", "n_words")).alias("__spans"))
    spans = spans.withColumnsRenamed({"doc_id": "__doc", "salt": "__doc_salt"})
    marked = docs.withColumn("__salt", _salt(text_col)).join(
        spans.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__salt") == F.col("__doc_salt")), "left")
    cut = F.arrow_udf(lean(_cut_words), "string")
    names = docs.columns
    done = marked.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(text_col, "__spans")))
    return done.where(F.col("__spans").isNull() | _has_word(text_col)).select(*names)
