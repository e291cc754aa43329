"""File streams: the batch operators applied to a streaming frame, and resumable runs.

All operators here are stateless, so a stream gives the rows the batch plan gives. Every
run uses the available-now trigger: it processes what has not been processed, then ends, and its
checkpoint makes a restart safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.rand import hash_uniform
from captionforge.operators.buckets import batch_positions
from captionforge.operators.positions import shard_contiguous


def stage_shards(df: DataFrame, order_by: list, num_shards: int, path: str) -> None:
    """Write a table as one folder per contiguous shard, the input form of ``stream_files``."""
    if num_shards > df.count():
        raise ValueError("more shards than rows")
    sharded = shard_contiguous(df, order_by, num_shards, "shard")
    sharded.repartition(num_shards, "shard").write.partitionBy("shard").parquet(path)


def stream_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None,
                 file_format: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # folder names such as shard=3 would otherwise add a column
    names = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return reader.format(file_format).load(path).select(*names)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything not yet processed to the parquet table ``out``."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply a batch function to every micro-batch.

    A micro-batch overwrites its own ``epoch`` folder, so one replayed after a failure adds nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def shuffle_buffer(stream: DataFrame, key: list[str], seed: int, out: str, checkpoint: str, place: str = "place") -> None:
    """Approximate shuffle: seeded order inside each micro-batch, which is the buffer.

    Rows carry the sort value as ``place``; reading by (epoch, place) gives the order.
    """
    draw = hash_uniform(seed, *map(F.col, key))
    run_batches(stream, lambda batch: batch.withColumn(place, draw).orderBy(place, *key), out, checkpoint)


def shuffle_reservoir(stream: DataFrame, key: list[str], seed: int, spread: int, out: str, checkpoint: str, place: str = "place") -> None:
    """Shuffle across micro-batches: a row stays in the reservoir for up to ``spread - 1`` of them, and leaves in seeded order.

    How long it stays is a draw of its key. The reservoir after micro-batch e is the table ``out/held/epoch=e``; rows that
    leave are in ``out/rows/epoch=e`` with their ``place`` there and ``came``, the micro-batch they came in. Both are
    overwritten if a micro-batch is replayed after a failure, from the reservoir before it, which is kept until the
    next one is done; so a restarted run gives the rows of an unbroken one. ``drain`` empties the reservoir at the end.
    """
    spark = stream.sparkSession
    stay = F.floor(hash_uniform(seed, *map(F.col, key), F.lit("stay")) * spread).cast("long")
    held_schema = T.StructType([*stream.schema.fields, *T.StructType.fromDDL(f"{place} double, came bigint, leaves bigint").fields])

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.withColumn(place, hash_uniform(seed, *map(F.col, key))).withColumn("came", F.lit(epoch).cast("long")).withColumn("leaves", F.col("came") + stay)
        rows = fresh
        if _folder_exists(spark, f"{out}/held/epoch={epoch - 1}"):
            rows = fresh.unionByName(spark.read.schema(held_schema).parquet(f"{out}/held/epoch={epoch - 1}"))
        rows.where(F.col("leaves") > epoch).write.mode("overwrite").parquet(f"{out}/held/epoch={epoch}")
        rows.where(F.col("leaves") <= epoch).drop("leaves").orderBy(place, *key).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        _delete_folder(spark, f"{out}/held/epoch={epoch - 2}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(spark: SparkSession, schema, out: str, last_epoch: int, key: list[str], place: str = "place") -> None:
    """Let the rows leave that the reservoir holds after ``last_epoch``, as the micro-batch behind it."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    held = spark.read.schema(T.StructType([*fields, *T.StructType.fromDDL(f"{place} double, came bigint, leaves bigint").fields]))
    held.parquet(f"{out}/held/epoch={last_epoch}").drop("leaves").orderBy(place, *key).write.mode("overwrite").parquet(f"{out}/rows/epoch={last_epoch + 1}")


def last_epoch(spark: SparkSession, out: str) -> int:
    """The last micro-batch whose reservoir is written, -1 if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/held")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    return max((int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")), default=-1)


def _folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def planned_batches(requests: DataFrame, draws: DataFrame, stats: DataFrame, index: DataFrame, batch_size: int,
                    seed: int, bucket: str = "bucket_size") -> DataFrame:
    """Rows of the requested batches: a stream of (first_batch, last_batch) ranges joined to static tables.

    Uses the plan functions of the batch sampler, so a streamed batch equals the planned one.
    """
    ids = requests.select(F.explode(F.sequence("first_batch", "last_batch")).alias("batch_id"))
    wanted = ids.join(draws, "batch_id")
    places = batch_positions(wanted, stats, batch_size, seed, bucket)
    return places.join(index, [bucket, "bucket_pos"]).drop("bucket_pos")


def stream_filter(stream: DataFrame, predicate: Column) -> DataFrame:
    return stream.where(predicate)
