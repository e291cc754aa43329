"""Writers, sharded saves and the publish plan."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.captions import shard_file_name
from captionforge.operators.positions import MAX_CUTS, shard_contiguous, shard_of, with_row_index

UNITS = {"KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, name: str, path: str | None = None, mode: str = "errorifexists") -> None:
    """Save as a catalog table."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "errorifexists", **options) -> None:
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options).save()


def to_local(df: DataFrame, form: str = "pandas"):
    """The whole (small) result as a pandas frame, Arrow table, dict of lists or list of dicts."""
    table = df.toArrow()
    return {"pandas": table.to_pandas, "arrow": lambda: table, "dict": table.to_pydict, "list": table.to_pylist}[form]()


def local_batches(df: DataFrame, batch_size: int) -> Iterator[pd.DataFrame]:
    """The result in pandas pieces; the driver holds one partition at a time."""
    block: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        block.append(row.asDict())
        if len(block) == batch_size:
            yield pd.DataFrame(block, columns=df.columns)
            block = []
    if block:
        yield pd.DataFrame(block, columns=df.columns)


def parse_size(size: int | str) -> int:
    if isinstance(size, int):
        return size
    for unit in sorted(UNITS, key=len, reverse=True):
        if size.upper().endswith(unit):
            return int(float(size[:-len(unit)]) * UNITS[unit])
    raise ValueError(f"{size} is not a size like 500MB")


def row_bytes(schema: T.StructType) -> Column:
    """Estimated in-memory bytes of a row: values, plus four bytes per variable-length offset."""
    def size(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 4
        if isinstance(t, T.ArrayType):
            if isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                items = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + size(x, t.elementType))
                return F.coalesce(items, F.lit(0)) + 4
            return F.coalesce(F.size(c), F.lit(0)) * _width(t.elementType) + 4
        if isinstance(t, T.StructType):
            return sum((size(c[f.name], f.dataType) for f in t), F.lit(0))
        return F.lit(_width(t))

    return sum((size(F.col(f"`{f.name}`"), f.dataType) for f in schema), F.lit(0)).cast("long")


def _width(t: T.DataType) -> int:
    narrow = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    return narrow.get(t.simpleString(), 8)


def shard_count(total_bytes: int, num_shards: int | None = None, max_shard_size: int | str | None = None,
                num_proc: int | None = None) -> int:
    if num_shards is not None and max_shard_size is not None:
        raise ValueError("give num_shards or max_shard_size, not both")
    if num_shards is not None:
        return num_shards
    limit = parse_size(max_shard_size if max_shard_size is not None else "500MB")
    return max(int(total_bytes / limit) + 1, num_proc or 1)


def save_sharded(df: DataFrame, order_by: list, path: str, num_shards: int | None = None,
                 max_shard_size: int | str | None = None, num_proc: int | None = None) -> DataFrame:
    """Save contiguous shards under ``path/data/shard=data-00000-of-00008/`` and return the manifest.

    With named keys, rows are labelled by the keys at the shards' borders and dealt and sorted once, a shard to a task. More
    than ``MAX_CUTS`` shards, or an order by expressions, sorts and numbers the rows first. ``row_idx`` gives
    the order inside a shard. The manifest, (shard, n_rows, n_bytes), is saved as ``path/manifest`` when the data are.
    """
    columns = df.columns
    sized = df.withColumn("__bytes", row_bytes(df.schema))
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("b")).first()
    shards, n = shard_count(total["b"] or 0, num_shards, max_shard_size, num_proc), total["n"]
    if shards <= MAX_CUTS and all(isinstance(c, str) for c in order_by):
        number = F.col("__shard")
        first = number * (n // shards) + F.least(number, F.lit(n % shards))
        inside = F.row_number().over(Window.partitionBy("__shard").orderBy(*order_by)) - 1
        named = shard_contiguous(df, order_by, shards, "__shard").withColumn("row_idx", first + inside)
    else:
        named = with_row_index(df, order_by, "row_idx").withColumn("__shard", shard_of(F.col("row_idx"), n, shards))
    named = named.select(shard_file_name("data", F.col("__shard"), F.lit(shards)).alias("shard"), "row_idx", *columns)
    named.sortWithinPartitions("shard", "row_idx").write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/data")
    written = df.sparkSession.read.schema(named.schema).parquet(f"{path}/data")
    manifest = written.withColumn("__bytes", row_bytes(df.schema)).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("__bytes").alias("n_bytes"))
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def load_saved(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A saved dataset; raises when a shard's rows do not match the manifest. Without rows it needs its ``schema``."""
    data = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/data")
    manifest = spark.read.parquet(f"{path}/manifest")
    found = data.groupBy("shard").agg(F.count(F.lit(1)).alias("__found"))
    wrong = manifest.join(found, "shard", "left").where(F.coalesce("__found", F.lit(0)) != F.col("n_rows"))
    if not wrong.isEmpty():
        raise ValueError(f"shards under {path} do not match their manifest")
    return data


VERSION = "version string, split string, folder string, n_rows bigint, n_bytes bigint, schema string"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a dataset of splits, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [f.getPath().getName() for f in system.listStatus(place)]
    done = [n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{n}/_SUCCESS"))]
    return sorted(int(n) for n in done if n.isdigit())


def save_splits(splits: dict[str, DataFrame], path: str, order_by: list, num_shards: int | None = None,
                max_shard_size: int | str | None = None) -> int:
    """Save named splits, which have the same columns, as one new version, and return its number.

    Every split is saved below a folder of this attempt. The last step writes the version's small table, which names
    these folders; until then, and if anything fails, readers see the version before. Two savers at a time cannot commit
    the same version: the second one fails.
    """
    if len({tuple((f.name, f.dataType) for f in df.schema) for df in splits.values()}) > 1:
        raise ValueError("all splits must have the same columns and types")
    if not splits:
        raise ValueError("there is nothing to save")
    spark = next(iter(splits.values())).sparkSession
    number = max(versions(spark, path), default=0) + 1
    attempt, rows = f"{number:05d}-{uuid.uuid4().hex}", []
    for name, df in splits.items():
        folder = f"files/{attempt}/{name}"
        sums = save_sharded(df, order_by, f"{path}/{folder}", num_shards, max_shard_size).agg(F.sum("n_rows"), F.sum("n_bytes")).first()
        saved = T.StructType([T.StructField("row_idx", T.LongType()), *df.schema.fields, T.StructField("shard", T.StringType())])
        rows.append((str(number), name, folder, sums[0] or 0, sums[1] or 0, saved.json()))
    spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/{number:05d}")
    return number


def load_splits(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The splits of a version (the last one committed), each checked against its manifest, without ``shard`` and ``row_idx``."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version or ''} under {path}, only {known}")
    table = spark.read.parquet(f"{path}/versions/{version or known[-1]:05d}")
    schema = lambda r: T.StructType.fromJson(json.loads(r["schema"]))
    return {r["split"]: load_saved(spark, f"{path}/{r['folder']}", schema(r)).drop("shard", "row_idx") for r in table.collect()}


def publish_plan(spark: SparkSession, total_shards: int, per_push: int, done: int, split: str = "train",
                 ledger: DataFrame | None = None, compat_total: bool = False) -> DataFrame:
    """(push_group, shard_no, file_name) still to publish.

    Groups of ``per_push`` files; publishing resumes at the group of the ``done``-th shard and
    skips files in ``ledger``. ``compat_total`` names a group's files after the group's own end
    instead of the true total.
    """
    groups, first = total_shards // per_push + 1, done // per_push
    plan = spark.range(first, groups).select(
        F.col("id").alias("push_group"), F.explode(F.sequence(F.lit(0), F.lit(per_push - 1))).alias("__i"))
    number = (F.col("push_group") * per_push + F.col("__i")).alias("shard_no")
    end = (F.col("push_group") + 1) * per_push if compat_total else F.lit(groups * per_push)
    plan = plan.select("push_group", number, end.alias("__end"))
    named = plan.withColumn("file_name", F.concat(shard_file_name(split, F.col("shard_no"), F.col("__end")), F.lit(".parquet")))
    named = named.drop("__end")
    return named if ledger is None else named.join(ledger.select("file_name"), "file_name", "left_anti")


def append_ledger(keys: DataFrame, path: str) -> None:
    keys.write.mode("append").parquet(path)
