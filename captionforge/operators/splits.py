"""Datasets made of named splits, held as one frame with a split column.

Any operator then runs on all splits in one job; positional operators number rows inside their
split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionforge.operators.ordering import with_draw
from captionforge.operators.positions import shard_of, with_group_index


def from_splits(frames: dict[str, DataFrame], split: str = "split") -> DataFrame:
    """One frame from named splits, which must have the same columns and types."""
    shapes = {frozenset((f.name, f.dataType) for f in df.schema) for df in frames.values()}
    if len(shapes) > 1:
        raise ValueError("all splits must have the same features")
    return reduce(DataFrame.unionByName, [df.withColumn(split, F.lit(name)) for name, df in frames.items()])


def one_split(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    return df.where(F.col(split) == name).drop(split)


def index_per_split(df: DataFrame, order_by: list, name: str = "row_idx", split: str = "split") -> DataFrame:
    return with_group_index(df, [split], order_by, name)


def shuffle_per_split(df: DataFrame, key: list[str], seed: int, name: str = "shuffled_idx", split: str = "split") -> DataFrame:
    drawn = with_draw(df, key, seed)
    return with_group_index(drawn, [split], [drawn.columns[-1], *key], name).drop(drawn.columns[-1])


def shard_per_split(df: DataFrame, order_by: list, shards: int, name: str = "shard", split: str = "split") -> DataFrame:
    """Contiguous shards of every split; the split sizes come back as one row per split."""
    placed = index_per_split(df, order_by, "__idx", split)
    sizes = placed.groupBy(split).agg(F.count(F.lit(1)).alias("__total"))
    return placed.join(sizes, split).withColumn(
        name, shard_of(F.col("__idx"), F.col("__total"), shards)).drop("__idx", "__total")


def unique_per_split(df: DataFrame, name: str, order: str, split: str = "split") -> DataFrame:
    return df.groupBy(split, name).agg(F.min(order).alias("first_seen"))
