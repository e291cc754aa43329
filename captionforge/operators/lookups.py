"""Key lookups, side-by-side concatenation and resume checks.

None of the joins carries a broadcast hint: Spark's size threshold decides, adaptive
execution splits the partitions of a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.functions.captions import stem_prefix, trim_text
from captionforge.operators.positions import with_row_index

# Fixed value: the class of rows whose captions come from a side table.
MERGED_CLASS = "CC12M"


def last_per_key(side: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row per key, the last in ``order``, as when rows are loaded into a dictionary.

    ``max_by`` pre-aggregates in each task before the shuffle, so a key repeated in a third of
    the rows costs one row per task.
    """
    order = F.col(order) if isinstance(order, str) else order
    values = [c for c in side.columns if c != key]
    latest = side.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("__last"))
    return latest.select(key, *[F.col("__last")[v].alias(v) for v in values])


def join_recaption(rows: DataFrame, side: DataFrame, order: str, row_id: str = "id", key: str = "key",
                   main_col: str = "caption_llava", short_col: str = "caption_llava_short",
                   fallback: str = "conversations", crossed: bool = True) -> DataFrame:
    """Swap captions for those of a side table.

    A row without a caption falls back to the second turn of ``fallback``; a missing short
    caption falls back to the main one. ``crossed`` keeps the original pairing, where
    the main caption comes from the short column and the other way round.
    ``missed`` marks the rows that belong in the error ledger.
    """
    main, short = (short_col, main_col) if crossed else (main_col, short_col)
    captions = last_per_key(side.select(key, main_col, short_col, order), key, order).select(
        F.col(key).cast("string").alias("__key"), F.col(main).alias("__main"), F.col(short).alias("__short"))
    joined = rows.join(captions, F.col(row_id).cast("string") == F.col("__key"), "left")
    recaption = trim_text(F.coalesce(F.col("__main"), F.get(F.col(fallback), 1)["value"]))
    return joined.withColumns({
        "missed": F.col("__main").isNull(),
        "recaption": recaption,
        "recaption_short": trim_text(F.coalesce(F.col("__short"), recaption)),
        "class": F.lit(MERGED_CLASS),
    }).drop("__key", "__main", "__short", fallback)


def join_recaption_misses(rows: DataFrame, side: DataFrame, row_id: str = "id", key: str = "key") -> DataFrame:
    """Rows that have no caption in the side table."""
    keys = side.select(F.col(key).cast("string").alias("__key"))
    return rows.join(keys, F.col(row_id).cast("string") == F.col("__key"), "left_anti")


def join_class_name(rows: DataFrame, classes: DataFrame, stem: str, class_key: str, class_name: str) -> DataFrame:
    """Class name by the part of the file stem before the first underscore; unknown ones drop out."""
    names = classes.select(F.col(class_key).alias("__key"), F.col(class_name).alias("class"))
    return rows.join(names, stem_prefix(F.col(stem)) == F.col("__key")).drop("__key")


def skip_processed(inputs: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return inputs.join(ledger.select(key), key, "left_anti")


def rows_of_class(rows: DataFrame, label: str, wanted: DataFrame) -> DataFrame:
    """Rows whose class is listed in ``wanted``."""
    return rows.join(wanted.select(label), label, "left_semi")


def zip_columns(left: DataFrame, left_order: list, right: DataFrame, right_order: list) -> DataFrame:
    """Put two datasets of equal length side by side, matched by position."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"duplicate columns {sorted(clash)}")
    a, b = with_row_index(left, left_order, "__idx"), with_row_index(right, right_order, "__idx")
    n_left, n_right = a.count(), b.count()
    if n_left != n_right:
        raise ValueError(f"row counts differ: {n_left} and {n_right}")
    return a.join(b, "__idx").drop("__idx")


def add_column(df: DataFrame, order_by: list, name: str, values: DataFrame, value_order: list) -> DataFrame:
    """Append the single column of ``values``, aligned by position."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    value = [c for c in values.columns if c not in value_order][0]
    placed = with_row_index(values, value_order, "__idx").select("__idx", F.col(value).alias(name))
    rows = with_row_index(df, order_by, "__idx")
    n_rows, n_values = rows.count(), placed.count()
    if n_rows != n_values:
        raise ValueError(f"row counts differ: {n_rows} and {n_values}")
    return rows.join(placed, "__idx").drop("__idx")
