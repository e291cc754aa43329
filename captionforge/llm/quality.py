"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by a filter's width, so that
every window of the whole text is seen. Bytes are embedded, ``FILTERS`` learned filters of eight bytes
run over each chunk with a step of four, their maxima over the chunk pass a small hidden layer to one
evidence value, and mean, maximum and minimum of a text's evidence give one probability.

It is fitted in one task on a bounded sample of labelled rows: at most ``PER_CLASS`` documents of each
label, those with the smallest id hashes, of at most ``TRAIN_BYTES`` bytes each (a step of the fit
holds the chunks of its whole texts). Scoring covers every byte of every text, in blocks of ``BLOCK`` chunks whatever the texts' sizes.

Defined cases: null and empty texts are one chunk of padding and get a score like others; ids that repeat
are scored row by row, and in the sample an id counts once per label, with its smallest text; null labels
are left out; without labels of both kinds every text scores the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.llm.text import lean, text_bytes, worker_cache
from captionforge.session import materialize, scratch_path, small_batches

CHUNK = 512
STEP = 4
EMBED = 8
FILTERS = 64
HIDDEN = 32
PAD = 256
BLOCK = 256         # chunks scored at once
PER_CLASS = 2048    # labelled documents of each label in the fit
TRAIN_BYTES = 16 << 10
STEPS = 700
BATCH = 32
CUT = 0.3

Model = dict[str, np.ndarray]


def chunk_table(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk in its text, and its text; a text has one chunk at least."""
    step = CHUNK - 2 * STEP
    counts = np.maximum(1, -(-(sizes - 2 * STEP) // step))
    rows = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return number * step, rows


def chunk_codes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of the chunks from ``begin``, padded where a text ends."""
    place = begin[:, None] + np.arange(CHUNK)
    codes = np.append(raw, 0)[np.minimum(place, len(raw))].astype(np.int16)
    codes[place >= end[:, None]] = PAD
    return codes


def _blocks(model: Model, codes: np.ndarray) -> np.ndarray:
    """Embedded bytes by blocks of ``STEP``: (chunks, blocks, STEP * EMBED)."""
    return model["embed"][codes].reshape(len(codes), CHUNK // STEP, STEP * EMBED)


def _maxima(model: Model, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk and filter the largest response and its place; a filter covers two neighbouring blocks."""
    responses = blocks[:, :-1] @ model["head"] + blocks[:, 1:] @ model["tail"]
    at = responses.argmax(axis=1)
    return np.take_along_axis(responses, at[:, None], axis=1)[:, 0] + model["bias"], at


def evidence(model: Model, codes: np.ndarray) -> np.ndarray:
    blocks = _blocks(model, codes)
    responses = blocks[:, :-1] @ model["head"]
    responses += blocks[:, 1:] @ model["tail"]
    pooled = np.maximum(responses.max(axis=1) + model["bias"], 0)
    return np.maximum(pooled @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"]


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text."""
    if "constant" in model:
        return np.full(len(texts), float(model["constant"]))
    raw, at = text_bytes(texts)
    starts, rows = chunk_table(np.diff(at))
    z = np.empty(len(rows), np.float64)
    for lo in range(0, len(rows), BLOCK):
        own = rows[lo:lo + BLOCK]
        first, last = at[own[0]], at[own[-1] + 1]
        z[lo:lo + BLOCK] = evidence(model, chunk_codes(raw[first:last], at[own] + starts[lo:lo + BLOCK] - first, at[own + 1] - first))
    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    if not len(heads):
        return np.zeros(0)
    mean = np.add.reduceat(z, heads) / np.diff(np.append(heads, len(z)))
    mix = model["pool"]
    logit = mix[0] * mean + mix[1] * np.maximum.reduceat(z, heads) + mix[2] * np.minimum.reduceat(z, heads) + mix[3]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on class-balanced log loss; a step sees the same number of texts of either label."""
    rng = np.random.default_rng(seed)
    kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not (len(kinds[0]) and len(kinds[1])):
        return {"constant": np.array(labels.mean() if len(labels) else 0.5)}
    width = STEP * EMBED
    draw = lambda *shape, fan: rng.normal(0, 1 / np.sqrt(fan), shape).astype(np.float32)
    model: Model = {
        "embed": draw(257, EMBED, fan=2), "head": draw(width, FILTERS, fan=2 * width), "tail": draw(width, FILTERS, fan=2 * width),
        "bias": np.zeros(FILTERS, np.float32), "w1": draw(FILTERS, HIDDEN, fan=FILTERS / 2), "b1": np.zeros(HIDDEN, np.float32),
        "w2": draw(HIDDEN, fan=HIDDEN), "b2": np.zeros(1, np.float32), "pool": np.array([1, 0.5, 0.5, 0], np.float32)}
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        grads = _gradients(model, [texts[i] for i in picked], labels[picked].astype(np.float32))
        rate = 0.004 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def _gradients(model: Model, texts: list[bytes], labels: np.ndarray) -> Model:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    starts, rows = chunk_table(np.diff(at))
    codes = chunk_codes(raw, at[rows] + starts, at[rows + 1])
    blocks = _blocks(model, codes)
    peak, place = _maxima(model, blocks)
    h = np.maximum(peak, 0)
    g_in = h @ model["w1"] + model["b1"]
    g = np.maximum(g_in, 0)
    z = g @ model["w2"] + model["b2"]
    heads = np.searchsorted(rows, np.arange(len(texts)))
    counts = np.diff(np.append(heads, len(rows)))
    mean, top, low = np.add.reduceat(z, heads) / counts, np.maximum.reduceat(z, heads), np.minimum.reduceat(z, heads)
    mix = model["pool"]
    p = 1 / (1 + np.exp(-np.clip(mix[0] * mean + mix[1] * top + mix[2] * low + mix[3], -30, 30)))
    d = (p - labels) / len(labels)
    dz = np.repeat(d * mix[0] / counts, counts)
    dz += np.where(z == np.repeat(top, counts), np.repeat(d * mix[1], counts), 0)
    dz += np.where(z == np.repeat(low, counts), np.repeat(d * mix[2], counts), 0)
    dg = dz[:, None] * model["w2"] * (g_in > 0)
    dh = (dg @ model["w1"].T) * (peak > 0)
    chunk = np.arange(len(codes))[:, None]
    one, two = blocks[chunk, place], blocks[chunk, place + 1]  # (chunks, filters, STEP * EMBED)
    embed = np.zeros_like(model["embed"])
    for part, offset in (("head", 0), ("tail", 1)):
        back = dh[:, :, None] * model[part].T  # what reaches the block under the peak
        spots = ((place + offset) * STEP)[:, :, None] + np.arange(STEP)
        np.add.at(embed, codes[chunk[:, :, None], spots].ravel(), back.reshape(-1, EMBED))
    return {"embed": embed, "head": np.einsum("cfw,cf->wf", one, dh), "tail": np.einsum("cfw,cf->wf", two, dh), "bias": dh.sum(axis=0),
            "w1": h.T @ dg, "b1": dg.sum(axis=0), "w2": g.T @ dz, "b2": np.array([dz.sum()]),
            "pool": np.array([(d * mean).sum(), (d * top).sum(), (d * low).sum(), d.sum()])}


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((r["doc_id"], r["text"] or "", r["label"]) for b in batches for r in b.to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    model = fit([t.encode() for _, t, _ in rows], np.array([q for _, _, q in rows], np.int64))
    packed = io.BytesIO()
    np.savez(packed, **model)
    yield pa.RecordBatch.from_pydict({"model": pa.array([packed.getvalue()], pa.binary())})


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = PER_CLASS) -> DataFrame:
    """One row ``model`` with the fitted network, in a written table."""
    usable = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    sample = None
    for kind in (0, 1):
        some = usable.where(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = some if sample is None else sample.union(some)
    short = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= TRAIN_BYTES).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = short.join(sample, short["doc_id"] == sample["id"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return materialize(rows.repartition(1).mapInArrow(lean(_fit_rows), "model binary"), "quality-model")


def with_score(docs: DataFrame, model: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; the weights (some 50 kB) travel with the tasks."""
    small_batches(docs.sparkSession)
    row, key = model.first(), scratch_path(docs.sparkSession, "weights")
    if row is None:  # nothing to learn from
        return docs.withColumn(out, F.lit(0.5))
    packed = bytes(row["model"])

    def score(texts: pa.Array) -> pa.Array:
        held = worker_cache()
        if held.get("quality_key") != key:
            held["quality_key"], held["quality"] = key, dict(np.load(io.BytesIO(packed)))
        return pa.array(score_texts(held["quality"], texts), pa.float64())

    return docs.withColumn(out, F.arrow_udf(lean(score), "double")(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the documents that score below ``cut``."""
    return with_score(docs, train(docs, labels, id_col, text_col), text_col, "__score").where(F.col("__score") >= cut).drop("__score")
