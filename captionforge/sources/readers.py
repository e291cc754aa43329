"""Readers. All of them are lazy; schemas are declared, never inferred by a pass over the data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.captions import file_extension
from captionforge.operators.positions import rows_per_file, with_row_index

IMAGE_SUFFIXES = ("png", "jpg", "jpeg")
URLS_PER_SHARD = 10000


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def with_file_name(df: DataFrame, name: str = "file") -> DataFrame:
    """The name of the file a row came from."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def read_jsonl(spark: SparkSession, path, schema, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    return df.select(*columns) if columns else df


def read_json_field(spark: SparkSession, path, field: str, row_schema: str) -> DataFrame:
    """Rows from the array under ``field`` of whole-file JSON documents."""
    wrapped = spark.read.schema(f"`{field}` array<struct<{row_schema}>>").option("multiLine", "true").json(path)
    return wrapped.select(F.inline(F.col(f"`{field}`")))


def read_csv(spark: SparkSession, path, schema, sep: str = ",", header: bool = True,
             multi_line: bool = False) -> DataFrame:
    """Delimited text; quotes inside quoted values are doubled.

    ``multi_line`` allows line breaks inside values, at the price of one task per file.
    """
    return (
        spark.read.schema(schema).option("sep", sep).option("header", header).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_text(spark: SparkSession, path) -> DataFrame:
    """One row per line, column ``text``."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def parse_class_list(lines: DataFrame, text: str = "text") -> DataFrame:
    """(class_id, names) from ``<id> <name>`` lines or ``<id>: '<names>',`` lines."""
    line = F.col(text)
    plain = r"^\s*(\d+)\s+(\S.*?)\s*$"
    quoted = r"""^\s*\{?\s*(\d+)\s*:\s*(['"])(.*)\2\s*,?\s*\}?\s*$"""
    class_id = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (quoted, plain)])
    names = F.coalesce(F.nullif(F.regexp_extract(line, quoted, 3), F.lit("")), F.regexp_extract(line, plain, 2))
    return lines.select(class_id.cast("int").alias("class_id"), names.alias("names")).where(F.col("class_id").isNotNull())


def read_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A query over frames named in it as ``{name}``."""
    return spark.sql(query, **frames)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0,
              upper: int = 0, partitions: int = 1, **options) -> DataFrame:
    """An external table; with a partition column it is read by that many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def from_memory(spark: SparkSession, data, schema=None) -> DataFrame:
    """Small in-memory data: dict of lists, list of dicts, pandas frame, Arrow table, or Arrow bytes."""
    if isinstance(data, (bytes, bytearray, pa.Buffer)):
        data = pa.ipc.open_stream(data).read_all()
    if isinstance(data, dict):
        data = pa.table(data)
    elif isinstance(data, list) and data and isinstance(data[0], dict):
        data = pa.Table.from_pylist(data)
    if schema is not None:
        return spark.createDataFrame(data, schema)
    return spark.createDataFrame(data)


def from_generator(spark: SparkSession, generator: Callable[..., Iterator[dict]], schema: str | T.StructType,
                   shards: list[dict]) -> DataFrame:
    """Rows of ``generator(**kwargs)``, one task per element of ``shards``."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = [(i, pickle.dumps(kwargs)) for i, kwargs in enumerate(shards)]
    plan = spark.createDataFrame(rows, "shard long, kwargs binary").repartitionByRange(len(shards), "shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["kwargs"]:
                block = []
                for row in generator(**pickle.loads(packed)):
                    block.append(row)
                    if len(block) == 1000:
                        yield pd.DataFrame(block, columns=fields.names)
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=fields.names)

    return plan.mapInPandas(run, fields)


def from_spark(df: DataFrame) -> DataFrame:
    return df


def read_image_folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, class, content) for every image below ``path``; the class is the parent folder.

    The suffix filter is applied to paths before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return image_rows(files, suffixes)


def image_rows(files: DataFrame, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    return files.where(file_extension(F.col("path")).isin(*suffixes)).select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), "content")


def url_list(df: DataFrame, url_col: str, caption_col: str, extra: list[str], order_by: list[str],
             per_shard: int = URLS_PER_SHARD) -> DataFrame:
    """Urls with captions, carried columns and the download shard of each row."""
    chosen = df.select(F.col(url_col).alias("url"), F.col(caption_col).alias("caption"), *extra,
                       *[F.col(c).alias(f"__o_{c}") for c in order_by])
    indexed = with_row_index(chosen, [f"__o_{c}" for c in order_by], "__idx")
    return indexed.withColumn("shard", rows_per_file(F.col("__idx"), per_shard)).drop(
        "__idx", *[f"__o_{c}" for c in order_by])


def table_shape(df: DataFrame) -> DataFrame:
    """(num_rows, num_columns, column_names, features)."""
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows", F.lit(len(df.columns)).alias("num_columns"), F.lit(",".join(df.columns)).alias("column_names"),
        F.lit(df.schema.simpleString()).alias("features"))


def split_shapes(df: DataFrame, split: str | Column = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("num_rows"))
