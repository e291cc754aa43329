"""Shape buckets: index, statistics, and the seeded size-weighted batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionforge.functions.captions import bucket_sides
from captionforge.functions.rand import hash_uniform
from captionforge.operators.positions import with_group_index
from captionforge.session import materialize

def bucket_stats(df: DataFrame, bucket: str = "bucket_size") -> DataFrame:
    """Rows per bucket and share of all rows."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def bucket_index(df: DataFrame, row: str = "row_idx", bucket: str = "bucket_size") -> DataFrame:
    """(bucket, bucket_pos, row): rows of each bucket numbered in ascending row order.

    Reads two columns only, and a bucket holding most rows is numbered by many tasks.
    """
    return with_group_index(df.select(bucket, row), [bucket], [row], "bucket_pos")


def class_index(df: DataFrame, row: str, label: str) -> DataFrame:
    return bucket_index(df, row, label)


def bucket_prune(stats: DataFrame, batch_size: int, bucket: str = "bucket_size") -> DataFrame:
    """Mark the buckets the sampler keeps, and those the original reports as removed.

    The two rules differ: it reports ``n <= batch`` but keeps only ``n > 3 * batch``.
    """
    return stats.select(
        bucket, "n", (F.col("n") > 3 * batch_size).alias("kept"), (F.col("n") <= batch_size).alias("reported"))


def kept_buckets(stats: DataFrame, batch_size: int) -> DataFrame:
    return stats.where(F.col("n") > 3 * batch_size)


def bucket_max_shape(stats: DataFrame, bucket: str = "bucket_size") -> DataFrame:
    """Component-wise largest shape; ``existing`` is null when no bucket has exactly that shape."""
    first, second = bucket_sides(F.col(bucket))
    sides = stats.agg(F.max(first).alias("first_side"), F.max(second).alias("second_side"))
    shaped = sides.withColumn("max_shape", F.concat_ws("x", F.col("first_side"), F.col("second_side")))
    present = stats.select(F.col(bucket).alias("existing"))
    return shaped.join(present, F.col("max_shape") == F.col("existing"), "left")


def bucket_epoch_len(stats: DataFrame, batch_size: int) -> DataFrame:
    """Batches in one pass: whole batches of every bucket, summed."""
    return stats.agg(F.sum(F.floor(F.col("n") / batch_size)).alias("n_batches"))


def draw_buckets(stats: DataFrame, n_batches: int, seed: int, bucket: str = "bucket_size",
                 first_n: int = 0) -> DataFrame:
    """(batch_id, bucket): each batch's bucket, drawn with probability n / total.

    A drawn row number falls in the bucket whose interval of row numbers holds it. A guide
    table cuts the number line into as many equal cells as there are buckets and lists the
    buckets touching each cell (two per cell on average), so the lookup is an equi-join on the
    cell. ``first_n`` batches are taken from the largest shape instead.
    """
    # windows and guide see one row per bucket
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    edges = stats.select(bucket, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    n_buckets, total = stats.agg(F.count(F.lit(1)), F.sum("n")).first()
    width = max(total // n_buckets, 1)
    last_row = F.col("__from") + F.col("n") - 1
    guide = edges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor(last_row / width))))
    row = F.floor(hash_uniform(seed, "bucket", F.col("id")) * total).cast("long")
    draws = stats.sparkSession.range(n_batches).select(F.col("id").alias("batch_id"), row.alias("__row")).withColumn(
        "__draw_cell", F.floor(F.col("__row") / width))
    drawn = draws.join(
        materialize(guide, "guide"),
        (F.col("__draw_cell") == F.col("__cell")) & F.col("__row").between(F.col("__from"), last_row),
    ).select("batch_id", bucket)
    if not first_n:
        return drawn
    largest = bucket_max_shape(stats, bucket).first()["existing"]
    if largest is None:
        raise ValueError("no bucket has the component-wise largest shape")
    return drawn.withColumn(bucket, F.when(F.col("batch_id") < first_n, F.lit(largest)).otherwise(F.col(bucket)))


def batch_positions(draws: DataFrame, stats: DataFrame, batch_size: int, seed: int, bucket: str = "bucket_size") -> DataFrame:
    """(batch_id, bucket, pos_in_batch, bucket_pos): a uniform sample of ``batch_size`` distinct places in the bucket.

    Place j is drawn from the first ``n - batch_size + j + 1``; one that the batch has already is replaced by the last
    of these. Every set of places is equally likely, and no bucket is ranked or collected. A bucket
    smaller than a batch raises.
    """
    n, size = F.col("n"), F.lit(batch_size)
    draws_of = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.struct(
        F.floor(hash_uniform(seed, "place", F.col("batch_id"), j) * (n - size + j + 1)).cast("long").alias("drawn"),
        (n - size + j).cast("long").alias("last")))
    picked = F.aggregate(draws_of, F.array().cast("array<bigint>"), lambda have, d: F.concat(
        have, F.array(F.when(F.array_contains(have, d["drawn"]), d["last"]).otherwise(d["drawn"]))))
    small = F.raise_error(F.concat(F.lit("a bucket has fewer rows than a batch: "), n.cast("string"))).cast("array<bigint>")
    return (
        draws.join(stats.select(bucket, "n"), bucket)
        .select("batch_id", bucket, F.posexplode(F.when(n < size, small).otherwise(picked)).alias("pos_in_batch", "bucket_pos"))
    )


def bucket_batches(rows: DataFrame, batch_size: int, seed: int, n_batches: int | None = None, row: str = "row_idx",
                   bucket: str = "bucket_size", first_n: int = 0) -> DataFrame:
    """A finite plan of the endless sampler: (batch_id, bucket, pos_in_batch, row).

    Buckets are drawn by size; rows do not repeat inside a batch, and may across batches.
    ``n_batches`` defaults to one epoch.
    """
    stats = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    stats = materialize(kept_buckets(stats, batch_size), "buckets")
    if n_batches is None:
        n_batches = bucket_epoch_len(stats, batch_size).first()["n_batches"] or 0
    if not n_batches:
        return rows.select(bucket, row).limit(0).select(
            F.lit(0).cast("long").alias("batch_id"), bucket, F.lit(0).alias("pos_in_batch"), row)
    draws = draw_buckets(stats, n_batches, seed, bucket, first_n)
    places = batch_positions(draws, stats, batch_size, seed, bucket)
    index = bucket_index(rows.join(stats.select(bucket), bucket, "left_semi"), row, bucket)
    return places.join(index, [bucket, "bucket_pos"]).select("batch_id", bucket, "pos_in_batch", row)
