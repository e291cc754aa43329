"""Benchmark decontamination by a broadcast hash set of benchmark word windows.

The benchmark is cut into blocks of at most ``BLOCK_BYTES`` of text. Each block is broadcast as one
hash set of its ``n``-word windows; the documents are scanned once per block (one block for any
usual benchmark), so what a task holds does not grow with either table. A window that is found by
its hash is verified word by word before it counts.

Defined cases: a null or empty text has no words and is not contaminated; a null item text has no
window; items with the same text are all found; repeated document rows each get their own result;
an empty benchmark leaves every document clean; columns of the input stay, and the added column is
named by the caller. A null ``item_id`` counts as an item with an empty id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import Words, lean, window_hashes, word_groups, worker_cache
from captionforge.session import materialize, scratch_path, small_batches

N_WORDS = 13
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 256 << 10

SCAN_TYPE = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
             "spans:array<struct<start:int,end:int>>>")


def _pieces(n: int, piece_bytes: int):
    """Cuts items into pieces of about ``piece_bytes`` that overlap by ``n - 1`` words: same windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out_id, out_no, out_text = batch.column(0).to_pylist(), [], [], []
            for words in word_groups(batch.column(1)):
                bounds = words.bounds()
                for r in range(words.n_rows):
                    lo, hi = int(bounds[r]), int(bounds[r + 1])
                    number = 0
                    while lo < hi:
                        upto = int(np.searchsorted(words.start[:hi], words.start[lo] + piece_bytes))
                        upto = min(hi, max(upto, lo + n))
                        out_id.append(ids[words.first_row + r] or "")
                        out_no.append(number)
                        out_text.append(words.phrase(lo, upto - lo).decode("utf-8", "replace"))
                        number, lo = number + 1, (hi if upto == hi else upto - n + 1)
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(out_id, pa.string()), "piece": pa.array(out_no, pa.int32()), "text": pa.array(out_text, pa.string())})

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items as normalised pieces, in lists of at most ``block_bytes`` of text."""
    named = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    pieces = materialize(
        named.mapInArrow(_pieces(n, min(PIECE_BYTES, block_bytes)), "item string, piece int, text string").dropDuplicates(), "benchmark")
    size = F.octet_length("text") + F.octet_length("item")
    total, longest = pieces.agg(F.sum(size), F.max(size)).first()
    blocks = (total or 0) // block_bytes + 1
    while True:
        slot = F.pmod(F.xxhash64("item", "piece", F.octet_length("text")), F.lit(blocks))
        largest = pieces.groupBy(slot.alias("slot")).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0
        if largest <= max(2 * block_bytes, longest or 0):  # a piece is not cut further
            break
        blocks *= 2
    if not largest:
        return
    for b in range(blocks):
        rows = pieces.where(slot == b).select("item", "text").collect()
        if rows:
            yield sorted((r["item"], r["text"]) for r in rows)


class WindowSet:
    """Windows of one block: sorted hashes for a whole batch at once, exact phrases for the hits."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.phrases: dict[bytes, list[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        ids = [i for i, _ in items]
        for words in word_groups(pa.array([t for _, t in items], pa.string())):
            bounds = words.bounds()
            sizes = np.diff(bounds)
            for length in {n, *(int(s) for s in np.unique(sizes) if 0 < s < n)}:
                found, first = window_hashes(words, length)
                keep = sizes[words.row[first]] >= n if length == n else sizes[words.row[first]] == length
                hashes.setdefault(length, []).append(found[keep])
                for k in first[keep]:
                    held = self.phrases.setdefault(words.phrase(int(k), length), [])
                    name = ids[words.first_row + int(words.row[k])]
                    if not held or held[-1] != name:
                        held.append(name)
        self.hashes = {length: np.unique(np.concatenate(h)) for length, h in hashes.items() if sum(map(len, h))}

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of every verified occurrence."""
        for length, known in self.hashes.items():
            found, first = window_hashes(words, length)
            at = np.searchsorted(known, found)
            at[at == len(known)] = 0
            for k in first[known[at] == found]:
                items = self.phrases.get(words.phrase(int(k), length))
                if items:
                    yield int(k), length, items


def _code_points(words: Words) -> np.ndarray:
    """Code points before each byte of the group."""
    return np.concatenate([[0], np.cumsum((words.lower & 0xC0) != 0x80)])


def scan_texts(texts: pa.Array, window_set: WindowSet, earlier: list | None = None) -> list[dict]:
    """Per text its word count, hit words, items and hit spans in code points, joined with ``earlier``.

    Spans are maximal runs of hit words: start of the first to end of the last.
    """
    out = []
    for words in word_groups(texts):
        bounds = words.bounds()
        hit = np.zeros(len(words.start) + 1, dtype=np.int32)
        items: dict[int, set[str]] = {}
        for k, length, names in window_set.hits(words):
            hit[k] += 1
            hit[k + length] -= 1
            items.setdefault(int(words.row[k]), set()).update(names)
        if earlier is not None or items:
            points = _code_points(words)
        if earlier is not None:
            for r in range(words.n_rows):
                before = earlier[words.first_row + r]
                if before["items"]:
                    items.setdefault(r, set()).update(before["items"])
                    base = points[words.text_start[r]]
                    starts = points[words.start[bounds[r]:bounds[r + 1]]] - base
                    for span in before["spans"]:
                        hit[bounds[r] + np.searchsorted(starts, span["start"])] += 1
                        hit[bounds[r] + np.searchsorted(starts, span["end"])] -= 1
        covered = np.cumsum(hit[:-1]) > 0
        for r in range(words.n_rows):
            lo, hi = bounds[r], bounds[r + 1]
            if r not in items:
                out.append({"n_words": int(hi - lo), "n_hit": 0, "items": [], "spans": []})
                continue
            mark = np.diff(np.concatenate([[0], covered[lo:hi].astype(np.int8), [0]]))
            base = points[words.text_start[r]]
            spans = [{"start": int(points[words.start[lo + a]] - base), "end": int(points[words.end[lo + b - 1]] - base)}
                     for a, b in zip(np.flatnonzero(mark == 1), np.flatnonzero(mark == -1))]
            out.append({"n_words": int(hi - lo), "n_hit": int(covered[lo:hi].sum()), "items": sorted(items[r]), "spans": spans})
    return out


_ARROW_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                         ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "scan", item_id: str = "item_id",
         item_text: str = "text", n: int = N_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (sorted ids) and spans (code points)."""
    spark = docs.sparkSession
    small_batches(spark)
    done = None
    for block in benchmark_blocks(benchmark, item_id, item_text, n, block_bytes):
        if done is not None:
            # beyond one block, rest on written rows, so that a task holds one block at a time
            docs = materialize(docs.withColumn(out, done), "scanned")
        shared, key = spark.sparkContext.broadcast(block), scratch_path(spark, "block")

        def window_set():
            held = worker_cache()
            if held.get("block_key") != key:
                held["block_key"], held["block"] = key, WindowSet(shared.value, n)
            return held["block"]

        if done is None:
            def first(texts: pa.Array) -> pa.Array:
                return pa.array(scan_texts(texts, window_set()), _ARROW_TYPE)

            done = F.arrow_udf(lean(first), SCAN_TYPE)(F.col(text_col))
        else:
            def further(texts: pa.Array, before: pa.Array) -> pa.Array:
                return pa.array(scan_texts(texts, window_set(), before.to_pylist()), _ARROW_TYPE)

            done = F.arrow_udf(lean(further), SCAN_TYPE)(F.col(text_col), F.col(out))
    if done is None:
        def count(texts: pa.Array) -> pa.Array:
            return pa.array(scan_texts(texts, WindowSet([], n)), _ARROW_TYPE)

        done = F.arrow_udf(lean(count), SCAN_TYPE)(F.col(text_col))
    return docs.withColumn(out, done)


def is_contaminated(scan_col: str = "scan", one_in: int = 20) -> Column:
    """At least one word in ``one_in`` is part of a benchmark window."""
    s = F.col(scan_col)
    return (s["n_hit"] > 0) & (s["n_hit"] * one_in >= s["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents",
                  one_in: int = 20, **kwargs) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit spans cut out of every text."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    mark = "__scan"
    scanned = scan(docs, benchmark, text_col, mark, **kwargs)
    if remove == "documents":
        return scanned.where(~is_contaminated(mark, one_in)).drop(mark)
    spans = F.col(f"{mark}.spans")
    kept_from = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    kept_to = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text_col)))
    parts = F.transform(F.arrays_zip(kept_from.alias("a"), kept_to.alias("b")),
                        lambda p: F.substring(F.col(text_col), p["a"] + 1, p["b"] - p["a"]))
    cut = F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text_col))
    return scanned.withColumn(text_col, cut).drop(mark)
