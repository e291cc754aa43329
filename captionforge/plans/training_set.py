"""From raw caption rows to bucketed training rows, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.functions.captions import bucket_string, capitalize, let, strip_openings_all
from captionforge.functions.shapes import is_high_resolution, phase_dims
from captionforge.operators.buckets import bucket_stats
from captionforge.operators.filters import keep_not_null, long_enough
from captionforge.operators.lookups import join_recaption, join_recaption_misses


def merge_captions(raw: DataFrame, side: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(training rows, error ledger) from raw rows and a caption side table.

    Raw rows have ``id``, ``image`` (struct with ``bytes``) and ``conversations``; the ledger lists
    the ids that had no caption.
    """
    narrow = raw.select("id", F.col("image.bytes").alias("image"), "conversations")
    merged = join_recaption(narrow, side, order)
    rows = merged.select("id", "image", "recaption", "recaption_short", "class")
    return rows, join_recaption_misses(raw.select("id"), side)


def clean_captions(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: capitalize(strip_openings_all(F.col(n))) for n in names})


def clean_and_keep(df: DataFrame, names: list[str]) -> DataFrame:
    """Clean the captions and keep the rows where all of them are still long enough."""
    cleaned = F.struct(*[capitalize(strip_openings_all(F.col(n))).alias(n) for n in names])
    judged = let(cleaned, lambda c: F.when(long_enough(*[c[n] for n in names]), c))
    return keep_not_null(df, "__captions", judged).withColumns(
        {n: F.col(f"__captions.{n}") for n in names}).drop("__captions")


def assign_buckets(df: DataFrame, first: str, second: str) -> DataFrame:
    """Add height, width, aspect_ratio and bucket_size; rows that cannot be resized are dropped."""
    shaped = df.withColumn("__dims", phase_dims(F.col(first), F.col(second))).where(F.col("__dims").isNotNull())
    height, width = F.col("__dims.height"), F.col("__dims.width")
    return shaped.withColumns({
        "height": height, "width": width, "aspect_ratio": width / height, "bucket_size": bucket_string(height, width),
    }).drop("__dims")


def build(df: DataFrame, first: str, second: str, long: str = "recaption", short: str = "recaption_short") -> DataFrame:
    """Low-resolution filter, caption cleaning, caption length filter, bucket assignment.

    The shape filter runs first: it needs two narrow columns, the caption steps rewrite text.
    """
    kept = df.where(is_high_resolution(F.col(first), F.col(second)))
    return assign_buckets(clean_and_keep(kept, [long, short]), first, second)


def rows_per_bucket(df: DataFrame) -> DataFrame:
    return bucket_stats(df)
