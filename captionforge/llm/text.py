"""Words of whole Arrow string columns as numpy arrays.

A word is a run of ASCII letters, digits and non-ASCII characters after A-Z are lower-cased, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. All words of a batch are found and hashed at once; nothing here
loops over words in Python. Texts are taken in groups of bounded bytes, so memory follows the group
(or the one text that is larger than a group), not the batch.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

GROUP_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANES = 8


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (functions of this package are pickled by value)."""
    return sys.modules.setdefault("_captionforge_worker_cache", types.ModuleType("_captionforge_worker_cache")).__dict__


def _give_back() -> None:
    """Free memory returns to the system, where other workers of the executor can use it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable) -> Callable:
    """``function``, a batch function or a generator over batches, that keeps no free memory when it is done.

    Idle Python workers live on for a while, and what their allocators hold counts against the executor.
    """
    if inspect.isgeneratorfunction(function):
        @functools.wraps(function)
        def run(*args):
            yield from function(*args)
            _give_back()
    else:
        @functools.wraps(function)
        def run(*args):
            out = function(*args)
            _give_back()
            return out

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: bytes ``lower[start:end]`` of row ``first_row + row``."""

    first_row: int
    n_rows: int
    lower: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    text_start: np.ndarray  # byte where each text begins, and one past the last

    def bounds(self) -> np.ndarray:
        """Index of the first word of each row, and one past the last."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def phrase(self, i: int, n: int) -> bytes:
        """``n`` words from word ``i``, joined by a space."""
        data = self.lower
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[i:i + n], self.end[i:i + n]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, and where each text starts and the last one ends. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_hashes(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time over all words that still have bytes left."""
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(lower) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _ODD
    todo = np.arange(len(start))
    for lane in range(_LANES):
        left = size[todo] - 8 * lane
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            return out
        value = lanes[start[todo] + 8 * lane]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[todo] = mix((out[todo] ^ value) * _ODD + np.uint64(lane))
    for i in np.flatnonzero(size > 8 * _LANES):
        out[i] = xxhash.xxh64_intdigest(lower[start[i]:end[i]].tobytes())
    return out


def word_groups(texts: pa.Array, group_bytes: int = GROUP_BYTES, hashed: bool = True) -> Iterator[Words]:
    """The words of a column, by groups of rows of about ``group_bytes``; every row is in one group. Hashes may be left out."""
    raw, at = text_bytes(texts)
    row, n = 0, len(at) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + group_bytes, "right")) - 1)
        lower = LOWER[raw[at[row]:at[upto]]]
        text_start = at[row:upto + 1] - at[row]
        inside = IN_WORD[lower]
        head = np.ones(len(lower) + 1, dtype=bool)  # a word cannot go on from one text to the next
        head[1:-1] = ~inside[:-1]
        head[text_start] = True
        begins = np.flatnonzero(inside & head[:-1])
        tail = np.ones(len(lower), dtype=bool)
        tail[:-1] = ~inside[1:]
        cuts = text_start[1:] - 1
        tail[cuts[cuts >= 0]] = True
        ends = np.flatnonzero(inside & tail) + 1
        rows = np.searchsorted(text_start, begins, "right") - 1
        yield Words(row, upto - row, lower, begins, ends, rows, word_hashes(lower, begins, ends) if hashed else np.zeros(0, np.uint64), text_start)
        row = upto


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _ODD) | np.uint64(1)


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` consecutive words of one text, and the window's first word."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += words.hash[j:j + count] * _STEPS[j]
    first = np.flatnonzero(words.row[:count] == words.row[n - 1:n - 1 + count])
    return mix(total[first]), first
