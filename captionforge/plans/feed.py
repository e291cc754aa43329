"""Batch feed: the batch plan joined to its rows, with every training-time draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.functions.vectors import cond_dropout_flags, time_sample
from captionforge.operators.buckets import bucket_batches


def training_feed(rows: DataFrame, payload: DataFrame, batch_size: int, seed: int, n_batches: int | None = None,
                  row: str = "row_idx", bucket: str = "bucket_size") -> DataFrame:
    """One row per (batch, position): the payload row, caption choice, dropout flags, noise level.

    The plan is built on two narrow columns; the payload is joined once, at the end.
    """
    plan = bucket_batches(rows, batch_size, seed, n_batches, row, bucket)
    place = (F.col("batch_id"), F.col("pos_in_batch"))
    return plan.join(payload, row).withColumns({
        "long_caption": hash_uniform(seed, "caption", F.col("batch_id")) < 0.5,
        **cond_dropout_flags(seed, "drop", *place),
        "t": time_sample(seed, "time", *place),
    })


def batch_pad_shape(rows: DataFrame, batch: str, height: str, width: str) -> DataFrame:
    """Largest sides per batch and the share of the padded area that is padding."""
    area = F.sum(F.col(height).cast("long") * F.col(width))
    padded = F.count(F.lit(1)) * F.max(height) * F.max(width)
    return rows.groupBy(batch).agg(
        F.max(height).alias("max_h"), F.max(width).alias("max_w"), (1.0 - area / padded).alias("padding"))
