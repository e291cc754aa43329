"""Chat formatting with offset-aligned loss masks.

Template. A turn is an opening marker, the text and a closing marker:

    user       [INST]text[/INST]        assistant  [ASST]text</s>
    system     [SYS]text[/SYS]          any other  [TURN]"role"newline text[/TURN]   (the role as a JSON string)

A control string inside a text gets a backslash after its first character, and one that already has
backslashes there gets one more, so unescaping gives the text back whatever it holds.

The rows of a conversation are dealt by blocks of ``TURNS`` neighbouring turn numbers, so a conversation of any
length is spread over tasks. A block is rendered as one string and encoded once with offsets; every marker is a
special token, so the ids of a conversation are those of its blocks one after the other. Assistant
spans and token spans are both sorted, and two binary searches per span find its tokens.

Defined cases: a null text or role is empty, and an empty or unknown role takes the last form; a null turn comes
first; turns that tie are ordered by role and text; repeated rows are repeated turns; a null
conversation id is one conversation; an empty table has no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import worker_cache
from captionforge.session import materialize, small_batches

TURNS = 64
BLOCK_CHARS = 1 << 18   # a block of turns is cut into strings of about so many characters
LOSS_ROLE = "assistant"

# The template's markers.
MARKERS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[TURN]", "[/TURN]")
CONTROL = [*(m for pair in MARKERS.values() for m in pair), *OTHER, "[/ASST]", "<s>"]

_FIRST = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))


def escape(text: str) -> str:
    return re.sub(rf"([{_FIRST}])(\\*)({_REST})", r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(rf"([{_FIRST}])\\(\\*)({_REST})", r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends there."""
    opening, closing = MARKERS.get(role, OTHER)
    head = opening if role in MARKERS else f"{opening}{escape(json.dumps(role))}\n"
    body = escape(text)
    return f"{head}{body}{closing}", len(head), len(head) + len(body)


_TURN = re.compile("|".join(
    [f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKERS.items()]
    + [rf"{re.escape(OTHER[0])}(?P<name>[^\n]*)\n(?P<other>.*?){re.escape(OTHER[1])}"]), re.DOTALL)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted string."""
    at = 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = found.end()
        kind = found.lastgroup
        if kind == "other":
            yield json.loads(unescape(found["name"])), unescape(found["other"])
        else:
            yield kind, unescape(found[kind])
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")


def token_spans(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """First token and one past the last that each sorted character span overlaps."""
    lo = np.searchsorted(ends, [a for a, _ in spans], "right")
    hi = np.searchsorted(starts, [b for _, b in spans], "left")
    return [(int(a), int(b)) if y > x and b > a else (int(a), int(a)) for (x, y), a, b in zip(spans, lo, hi)]


class ChatEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers, processors

        self.tokenizer = Tokenizer.from_file(path)
        # every byte of a text has a token with its true place
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.tokenizer.post_processor = processors.ByteLevel(add_prefix_space=False, trim_offsets=False)
        # the tokenizer's own special strings are text here; the template's markers are cut out before it
        self.tokenizer.encode_special_tokens = True
        self.markers = {m: self.tokenizer.get_vocab_size() + i for i, m in enumerate(CONTROL)}
        self.cut = re.compile("|".join(re.escape(m) for m in sorted(CONTROL, key=len, reverse=True)))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and first and last character of each token, of one string."""
        pieces, at = [], 0
        for found in self.cut.finditer(text):
            pieces += [(at, text[at:found.start()], None), (found.start(), None, found[0])]
            at = found.end()
        pieces = [p for p in [*pieces, (at, text[at:], None)] if p[1] != ""]
        encoded = iter(self.tokenizer.encode_batch([t for _, t, m in pieces if m is None], add_special_tokens=False))
        ids, starts, ends = [], [], []
        for begin, _, marker in pieces:
            if marker is not None:
                ids.append(self.markers[marker])
                starts.append(begin)
                ends.append(begin + len(marker))
            else:
                piece = next(encoded)
                ids += piece.ids
                starts += [begin + a for a, _ in piece.offsets]
                ends += [begin + b for _, b in piece.offsets]
        return np.array(ids, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


_BLOCK = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()),
                    ("ids", pa.list_(pa.int32())), ("loss_tokens", pa.list_(pa.struct([("first", pa.int32()), ("upto", pa.int32())]))),
                    ("loss_chars", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_BLOCK_DDL = ("conv_id bigint, block bigint, part int, n_turns int, formatted string, ids array<int>, "
              "loss_tokens array<struct<first:int,upto:int>>, loss_chars array<struct<start:int,end:int>>")


def _format(path: str, loss_role: str, block_chars: int):
    """Rows sorted by (conv_id, block, turn, role, text) to one formatted string, or several, per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache()
        if held.get("chat_path") != path:
            held["chat_path"], held["chat"] = path, ChatEncoder(path)
        encoder = held["chat"]
        current, part, turns, size = None, 0, [], 0

        def finish() -> dict:
            spans, at = [], 0
            for role, (text, lo, hi) in turns:
                if role == loss_role:
                    spans.append((at + lo, at + hi))
                at += len(text)
            formatted = "".join(text for _, (text, _, _) in turns)
            ids, starts, ends = encoder.encode(formatted)
            tokens = token_spans(spans, starts, ends)
            # what the masked tokens stand for, held to the span where a token should reach over its border
            chars = [(max(a, int(starts[lo])), min(b, int(ends[hi - 1]))) if hi > lo else (a, a) for (a, b), (lo, hi) in zip(spans, tokens)]
            return {"conv_id": current[0], "block": current[1], "part": part, "n_turns": len(turns), "formatted": formatted, "ids": ids.tolist(),
                    "loss_tokens": [{"first": a, "upto": b} for a, b in tokens], "loss_chars": [{"start": a, "end": b} for a, b in chars]}

        for batch in batches:
            out, weight = [], 0
            convs, blocks, roles, texts = (batch.column(i) for i in range(4))
            for conv, block, role, i in zip(convs.to_pylist(), blocks.to_pylist(), roles.to_pylist(), range(batch.num_rows)):
                if current != (conv, block) or size >= block_chars:
                    if turns:
                        out.append(finish())
                        weight += size
                    part = part + 1 if current == (conv, block) else 0
                    current, turns, size = (conv, block), [], 0
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
                        out, weight = [], 0
                turns.append((role or "", render(role or "", texts[i].as_py() or "")))
                size += len(turns[-1][1][0])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
        if turns:
            yield pa.RecordBatch.from_pylist([finish()], schema=_BLOCK)

    return run


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def format_conversations(turns: DataFrame, tokenizer: str | None = None, loss_role: str = LOSS_ROLE, turns_per_block: int = TURNS,
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Formatted strings of conversations (conv_id, turn, role, text), their ids and loss masks.

    A conversation is its rows in the order of (block, part); ``loss_tokens`` are the masked tokens, as ranges,
    and ``loss_chars`` what they stand for in ``formatted``.
    """
    small_batches(turns.sparkSession)
    rows = turns.select("conv_id", F.floor(F.col("turn") / turns_per_block).cast("long").alias("block"), "role", "text", "turn")
    # (conv_id, block) is the unit of work: a long conversation is in many tasks
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return dealt.select("conv_id", "block", "role", "text").mapInArrow(_format(tokenizer or tokenizer_path(), loss_role, block_chars), _BLOCK_DDL)


_SUM = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_SUM_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted rows sorted by (conv_id, block, part) to one digest row per conversation, a row at a time."""
    current, state = None, None
    for batch in batches:
        out = []
        names = {c: batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "formatted", "loss_chars")}
        for i, conv in enumerate(names["conv_id"].to_pylist()):
            if state is None or conv != current:
                if state is not None:
                    out.append(_digest(current, state))
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = names["formatted"][i].as_py()
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in names["loss_chars"][i].as_py():
                text = unescape(formatted[span["start"]:span["end"]])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SUM)
    if state is not None:
        yield pa.RecordBatch.from_pylist([_digest(current, state)], schema=_SUM)


def _digest(conv, state: list) -> dict:
    return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(),
            "formatted_chars": state[4]}


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of its turns and of the text under the loss mask, from the formatted rows.

    A SHA-256 over a whole conversation can only be computed in order: the strings of a conversation pass one
    task, one at a time, with no more in memory than one of them. All the work of formatting is done before.
    """
    narrow = formatted.select("conv_id", "block", "part", "formatted", "loss_chars")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(_read_back, _SUM_DDL)


def formatted_table(turns: DataFrame, **kwargs) -> DataFrame:
    """``format_conversations`` written once."""
    return materialize(format_conversations(turns, **kwargs), "chat")
