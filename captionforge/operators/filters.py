"""Row filters and the quality report."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.operators.positions import with_row_index

MIN_CAPTION_CHARS = 10


def filter_rows(df: DataFrame, predicate) -> DataFrame:
    """Keep rows where the predicate (a Column, or a function of the frame) is true."""
    return df.where(predicate if isinstance(predicate, Column) else predicate(df))


def filter_python(df: DataFrame, predicate, input_columns: list[str] | None = None, batched: bool = False, **fn_kwargs) -> DataFrame:
    """Keep rows for which a Python function is true.

    It gets a row as a dict or, with ``batched``, a dict of lists and returns a list of booleans; only
    ``input_columns`` cross to Python, and the rows themselves stay in the JVM.
    """
    names = list(input_columns or df.columns)

    def decide(rows: pa.Array) -> pa.Array:
        if batched:
            columns = {c: rows.field(i).to_pylist() for i, c in enumerate(names)}
            return pa.array([bool(v) for v in predicate(columns, **fn_kwargs)], pa.bool_())
        return pa.array([bool(predicate(row, **fn_kwargs)) for row in rows.to_pylist()], pa.bool_())

    return df.where(F.arrow_udf(decide, "boolean")(F.struct(*[F.col(f"`{c}`") for c in names])))


def filter_with_index(df: DataFrame, order_by: list, predicate) -> DataFrame:
    """``predicate(row_idx)`` decides by position."""
    return with_row_index(df, order_by, "__idx").where(predicate(F.col("__idx"))).drop("__idx")


def dropna_subset(df: DataFrame, names: list[str]) -> DataFrame:
    return df.dropna(subset=names)


def keep_not_null(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column and drop the rows where it is null, computing it once.

    A filter on a projected column is pushed below the projection and computes the value again;
    it cannot pass the one-row generator. (``explode`` would infer such a filter itself.)
    """
    return df.withColumn(name, F.explode_outer(F.array(value))).where(F.col(name).isNotNull())


def long_enough(*captions: Column) -> Column:
    keep = F.lit(True)
    for c in captions:
        keep = keep & (F.length(c) >= MIN_CAPTION_CHARS)
    return keep


def filter_status(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) == "success")


def surviving_files(df: DataFrame, file_col: str, min_rows: int = 1) -> DataFrame:
    """Files that keep at least ``min_rows`` rows, with their counts."""
    return df.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)


def require_rows_per_file(df: DataFrame, file_col: str, min_rows: int = 10) -> DataFrame:
    """Per-file row counts; raises when a file keeps too few rows."""
    counts = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"))
    too_few = F.raise_error(F.concat(F.lit("no captions were generated for "), F.col(file_col)))
    return counts.withColumn("n_rows", F.when(F.col("n_rows") >= min_rows, F.col("n_rows")).otherwise(too_few.cast("long")))


def quality_report(df: DataFrame, file_col: str, kept: Column) -> DataFrame:
    """Rows in, kept and dropped per file, plus a total row with a null file."""
    report = df.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(kept).alias("n_kept")
    )
    total = report.agg(F.sum("n_in").alias("n_in"), F.sum("n_kept").alias("n_kept")).select(
        F.lit(None).cast("string").alias(file_col), "n_in", "n_kept"
    )
    dropped = F.col("n_in") - F.col("n_kept")
    return report.unionByName(total).withColumn("n_dropped", dropped).withColumn(
        "pct_dropped", F.try_divide(F.lit(100.0) * F.col("n_dropped"), F.col("n_in"))
    )
