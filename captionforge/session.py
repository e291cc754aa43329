"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "captionforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle partitions are left to the cluster's own configuration; adaptive execution
    coalesces them and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="captionforge-"))
    return sc.getCheckpointDir().rstrip("/")


ARROW_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts of at most ``ARROW_BATCH_BYTES``, unless the session asks for even smaller ones.

    A batch is held several times, by the JVM and by the Python worker, for each running task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


COLUMN_BATCH_ROWS = 512


def small_columns(spark: SparkSession) -> None:
    """Column batches of at most ``COLUMN_BATCH_ROWS`` rows from Parquet, for tables of some kilobytes a row.

    A reader keeps the largest batch it has met, and twice that while it grows, in the JVM of the executor, for each running task.
    """
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > COLUMN_BATCH_ROWS:
        spark.conf.set(key, str(COLUMN_BATCH_ROWS))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    The table outlives lost executors, is computed once however often it is used, stays
    column-prunable, and has a known size, so Spark's own broadcast threshold decides how
    it is joined.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


ROWS_PER_TASK = 1 << 18


def in_tasks(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, made of about ``rows`` narrow rows, in as many tasks as these need, if it has more.

    A job of many short steps otherwise starts a task, and writes a file, for each shuffle partition in each step,
    unless adaptive execution merges them. Tasks grow in number with the rows.
    """
    return df.coalesce(max(1, -(-int(rows) // rows_per_task)))


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files behind DataFrames that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which a driver with little to do rarely does by itself
    (``spark.cleaner.periodicGC.interval``, half an hour by default). Jobs of several waves call this between them.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a query that runs inside as soon as it ends, not when the driver collects its garbage.

    For waves that write what the next ones read: a query that runs twice from the same exchange deals its rows again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, when nothing that is still lazy reads them."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path is None:
            raise ValueError("not a table of the scratch folder")
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
