"""Token counts of sections, attributed by offsets.

A whole text is encoded once. A byte-level vocabulary loses nothing, so the byte lengths of the tokens add
up to their spans in the text. Sections are sorted byte spans, and an interval join by binary search gives each
token its section; a token that reaches over a border is allocated by an explicit rule:

    start      to the section of its first byte
    majority   to the section that has most of its bytes, the earlier one on a tie
    split      to every section it touches, by bytes, as fractions

Defined cases: a null or empty text has no token and one empty section; an empty section has no token; texts of
any length are encoded whole; repeated rows are counted each; an empty table has no rows; further columns stay.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import text_bytes, worker_cache

RULES = ("start", "majority", "split")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens:
    """Ids of a byte-level vocabulary of ranks, and each id's number of bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(token) for token in ranks]

    def ends(self, text: str) -> np.ndarray:
        """One past the last byte of each token."""
        return np.cumsum(self.size[self.coder.encode_ordinary(text)])


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Where the lines of a text begin; a line keeps its break."""
    return np.append(0, np.flatnonzero(raw[:-1] == 10) + 1)


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens reach over a border.

    ``starts`` are the sections' first bytes, from 0; a section goes up to the next one.
    """
    begins = np.append(0, ends)[:-1]
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(last > first)
    if rule == "start":
        return np.bincount(first, minlength=len(starts)).astype(float), len(crossing)
    inside = np.bincount(first[last == first], minlength=len(starts)).astype(float)
    for t in crossing:
        parts = np.arange(first[t], last[t] + 1)
        upper = np.append(starts, ends[-1])[parts + 1]
        share = np.minimum(upper, ends[t]) - np.maximum(starts[parts], begins[t])
        if rule == "majority":
            inside[parts[share.argmax()]] += 1
        else:
            inside[parts] += share / (ends[t] - begins[t])
    return inside, len(crossing)


_COUNTS = "struct<n_tokens:bigint,n_crossing:bigint,sections:array<struct<start:bigint,end:bigint,tokens:double>>>"
_SECTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64())])


def _count(path: str, rule: str, given: bool):
    def run(texts: pa.Array, starts: pa.Array | None) -> pa.Array:
        held = worker_cache()
        if held.get("tokens_path") != path:
            held["tokens_path"], held["tokens"] = path, ByteTokens(path)
        coder = held["tokens"]
        raw, at = text_bytes(texts)
        tokens, crossings, sizes, begin, end, share = [], [], [0], [], [], []
        for r in range(len(texts)):
            own = raw[at[r]:at[r + 1]]
            if given:
                asked = np.array(starts[r].as_py() or [], np.int64)
                edges = np.unique(np.append(0, asked[(asked > 0) & (asked < len(own))]))
            else:
                edges = line_starts(own)
            ends = coder.ends(texts[r].as_py() or "")
            counts, over = allocate(ends, edges, rule) if len(ends) else (np.zeros(len(edges)), 0)
            tokens.append(len(ends))
            crossings.append(over)
            sizes.append(len(edges))
            begin.append(edges)
            end.append(np.append(edges[1:], len(own)))
            share.append(counts)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        sections = pa.StructArray.from_arrays([flat(begin, pa.int64()), flat(end, pa.int64()), flat(share, pa.float64())], fields=list(_SECTION))
        return pa.StructArray.from_arrays(
            [pa.array(tokens, pa.int64()), pa.array(crossings, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), sections)],
            ["n_tokens", "n_crossing", "sections"])

    if given:
        return lambda texts, starts: run(texts, starts)
    return lambda texts: run(texts, None)


def count_tokens(text_col: str = "text", starts_col: str | None = None, rule: str = "majority", tokenizer: str | None = None) -> Column:
    """Struct of n_tokens, n_crossing and sections (byte span, tokens).

    Sections begin at the bytes in ``starts_col`` (and at 0), or are lines. Starts outside the text are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    path = tokenizer or tokenizer_path()
    if starts_col is None:
        def lines(texts: pa.Array) -> pa.Array:
            return _count(path, rule, False)(texts)

        return F.arrow_udf(lines, _COUNTS)(F.col(text_col))

    def given(texts: pa.Array, starts: pa.Array) -> pa.Array:
        return _count(path, rule, True)(texts, starts)

    return F.arrow_udf(given, _COUNTS)(F.col(text_col), F.col(starts_col))


def count_fields(rows: DataFrame, fields: list[str], rule: str = "majority", separator: str = "\n\n", tokenizer: str | None = None,
                 out: str = "tokens") -> DataFrame:
    """``rows`` with ``out``: the tokens of each of ``fields`` when they are joined by ``separator`` and encoded as one text.

    A separator belongs to the field before it.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    whole = F.concat_ws(separator, *values)
    starts, at = [], F.lit(0)
    for value in values[:-1]:
        at = at + F.octet_length(value) + len(separator.encode())
        starts.append(at.cast("bigint"))
    joined = rows.withColumns({"__whole": whole, "__starts": F.array(*starts) if starts else F.array().cast("array<bigint>")})
    counted = joined.withColumn("__counted", count_tokens("__whole", "__starts", rule, tokenizer))
    # a field that is empty at the end, or follows an empty start, has no section of its own
    span = lambda i: F.coalesce(F.get(F.transform(F.filter(
        "__counted.sections", lambda s: s["start"] == (F.lit(0) if i == 0 else F.get("__starts", F.lit(i - 1)))), lambda s: s["tokens"]), F.lit(0)), F.lit(0.0))
    return counted.withColumn(out, F.struct(*[span(i).alias(c) for i, c in enumerate(fields)])).drop("__whole", "__starts", "__counted")
