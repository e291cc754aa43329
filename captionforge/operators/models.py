"""Jobs around plugged-in models, codecs and fetchers.

A plug-in is a factory: called once per Python worker, it returns a function on a pandas
batch. Everything around the model stays in column expressions.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.captions import (
    caption_reject,
    long_caption_prompt,
    short_caption_prompt,
    strip_openings_fold,
)
from captionforge.functions.shapes import phase_dims
from captionforge.functions.vectors import pad_concat
from captionforge.operators.filters import keep_not_null

BatchModel = Callable[[pd.DataFrame], pd.Series]
ModelFactory = Callable[[], BatchModel]

# Http statuses that are not worth another attempt, and the attempt limit.
GIVE_UP_STATUSES = [400, 401, 402, 403, 404]
MAX_RETRIES = 5
# Images per caption model call, urls per download task.
CAPTION_BATCH = 64
URLS_PER_TASK = 10000
FETCH_BYTES = 32 << 20  # downloaded bodies a task holds before it passes them on


def model_column(factory: ModelFactory, return_type: str, *inputs: Column, batch_size: int | None = None) -> Column:
    """Apply a batch model to columns; row-aligned by construction.

    ``batch_size`` bounds what the model sees at once, whatever the size of the Arrow batches.
    """

    @F.pandas_udf(return_type)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            size = batch_size or max(len(batch), 1)
            pieces = [model(batch.iloc[lo:lo + size].reset_index(drop=True)) for lo in range(0, len(batch), size)]
            yield pd.concat(pieces, ignore_index=True) if pieces else pd.Series([], dtype=object)

    return run(F.struct(*inputs))


def recaption(rows: DataFrame, hint: str, image: str, long_model: ModelFactory, short_model: ModelFactory,
              long_name: str = "recaption", short_name: str = "recaption_short",
              batch_size: int = CAPTION_BATCH) -> DataFrame:
    """Long caption from image and hint, cleaned and judged, then a short caption of it.

    Rows whose long caption is rejected are dropped before the short model runs.
    """
    prompted = rows.withColumn("__raw", model_column(
        long_model, "string", F.col(image).alias("image"), long_caption_prompt(F.col(hint)).alias("prompt"),
        batch_size=batch_size))
    kept = keep_not_null(prompted, long_name, caption_reject(strip_openings_fold(F.col("__raw")))).drop("__raw")
    return kept.withColumn(short_name, model_column(
        short_model, "string", short_caption_prompt(F.col(long_name)).alias("prompt"), batch_size=batch_size))


def encode_text(rows: DataFrame, text: str, wide: ModelFactory, narrow: ModelFactory, pooled: ModelFactory) -> DataFrame:
    """Text states of two encoders, the narrow one zero-padded and appended, plus a pooled vector."""
    vector = "array<double>"
    states = rows.withColumns({
        "__wide": model_column(wide, vector, F.col(text).alias("text")),
        "__narrow": model_column(narrow, vector, F.col(text).alias("text")),
        "text_pooled": model_column(pooled, vector, F.col(text).alias("text")),
    })
    return states.withColumn("text_states", pad_concat(F.col("__wide"), F.col("__narrow"))).drop("__wide", "__narrow")


def image_features(rows: DataFrame, image: str, classifier: ModelFactory, name: str = "features") -> DataFrame:
    return rows.withColumn(name, model_column(classifier, "array<double>", F.col(image).alias("image")))


def resize_images(rows: DataFrame, first: str, second: str, image: str, codec: ModelFactory) -> DataFrame:
    """Re-encode images at their bucket shape; rows without a shape, or the codec nulls, drop out."""
    shaped = rows.withColumn("__dims", phase_dims(F.col(first), F.col(second))).where(F.col("__dims").isNotNull())
    resized = shaped.withColumn(image, model_column(
        codec, "binary", F.col(image).alias("image"), F.col("__dims.height").alias("height"),
        F.col("__dims.width").alias("width")))
    return resized.where(F.col(image).isNotNull()).withColumns(
        {"height": F.col("__dims.height"), "width": F.col("__dims.width")}).drop("__dims")


def fetch_triage(status: Column, attempt: Column) -> Column:
    """keep, give_up or retry for one attempt (status null = connection error)."""
    return (
        F.when(status.between(200, 399), "keep")
        .when(status.isin(GIVE_UP_STATUSES) | (attempt > MAX_RETRIES), "give_up")
        .otherwise("retry")
    )


def fetch(rows: DataFrame, url: str, fetcher: Callable[[], Callable[[str, int], tuple[int | None, bytes | None]]],
          threads: int = 16, content: str = "content", urls_per_task: int = URLS_PER_TASK) -> DataFrame:
    """Download every url; ``fetcher()`` returns ``get(url, attempt) -> (status, bytes)``.

    Adds the content, the last status and the number of attempts; failed rows have null
    content. Url rows are small, so a file of them would be one long task: they are spread to
    ``urls_per_task`` each, and downloads overlap in threads inside a task.
    """
    added = T.StructType.fromDDL(f"{content} binary, status int, attempts int")
    schema = T.StructType([*rows.schema.fields, *added])

    def one(get, address: str) -> tuple:
        status = None
        for attempt in range(MAX_RETRIES + 2):
            try:
                status, body = get(address, attempt)
            except OSError:
                status, body = None, None
            if status is not None and 200 <= status < 400:
                return body, status, attempt + 1
            if status in GIVE_UP_STATUSES:
                break
        return None, status, attempt + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = fetcher()

        def block(rows: pa.RecordBatch, results: list[tuple]) -> pa.RecordBatch:
            new = [pa.array([r[i] for r in results], kind) for i, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*rows.schema.names, content, "status", "attempts"])

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                # a few downloads per thread at a time, passed on when their bodies reach FETCH_BYTES
                addresses, begun, results, held = batch.column(batch.schema.get_field_index(url)).to_pylist(), 0, [], 0
                for at in range(0, len(addresses), threads):
                    for result in pool.map(lambda a: one(get, a), addresses[at:at + threads]):
                        results.append(result)
                        held += len(result[0] or b"")
                    if held >= FETCH_BYTES:
                        yield block(batch.slice(begun, len(results)), results)
                        begun, results, held = begun + len(results), [], 0
                if results:
                    yield block(batch.slice(begun), results)

    tasks = -(-rows.count() // urls_per_task) or 1
    return rows.repartition(tasks).mapInArrow(run, schema)


def split_fetched(fetched: DataFrame, key: str, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows with content, failure ledger)."""
    return fetched.where(F.col(content).isNotNull()), fetched.where(F.col(content).isNull()).select(key, "status", "attempts")


# ---- deterministic stand-ins, used where no model is plugged in ----

def hashed_words(width: int) -> ModelFactory:
    """Unit-length hashed bag of words of the ``text`` column."""

    def factory() -> BatchModel:
        def encode(text: str | None) -> np.ndarray:
            v = np.zeros(width)
            for word, n in Counter((text or "").split()).items():
                v[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width] += n
            norm = np.linalg.norm(v)
            return v / norm if norm else v

        return lambda batch: batch["text"].map(encode)

    return factory


def echo_prompt(prefix: str = "") -> ModelFactory:
    """Answers with the text between the prompt's fences, after ``prefix``."""

    def factory() -> BatchModel:
        fence = "\\`\\`\\`\n    "

        def answer(prompt: str) -> str:
            return prefix + prompt.split(fence, 1)[1].rsplit("\n    " + fence[:6], 1)[0]

        return lambda batch: batch["prompt"].map(answer)

    return factory
