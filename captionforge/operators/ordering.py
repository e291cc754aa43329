"""Sorting, seeded shuffles and exact train/test splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.operators.positions import Border, keys_at, with_group_index, with_part, with_row_index
from captionforge.session import materialize


def sort_columns(names: list[str], reverse: bool | list[bool] = False, null_placement: str = "at_end") -> list[Column]:
    """Sort keys with nulls last (or first) in either direction."""
    flags = [reverse] * len(names) if isinstance(reverse, bool) else list(reverse)
    if len(flags) != len(names):
        raise ValueError("reverse needs one flag per column")
    if null_placement not in ("at_end", "at_start"):
        raise ValueError("null_placement is at_end or at_start")
    last = null_placement == "at_end"

    def key(name: str, down: bool) -> Column:
        c = F.col(name)
        if down:
            return c.desc_nulls_last() if last else c.desc_nulls_first()
        return c.asc_nulls_last() if last else c.asc_nulls_first()

    return [key(n, f) for n, f in zip(names, flags)]


def sort(df: DataFrame, names: list[str], reverse: bool | list[bool] = False, null_placement: str = "at_end") -> DataFrame:
    return df.orderBy(*sort_columns(names, reverse, null_placement))


_DRAW = "__draw"
DRAW_BINS = 4096  # also the number of counts the driver sees


def with_draw(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Add the seeded draw of each row key; sorting by (draw, key) is the seeded permutation.

    A column of its own, because a sort evaluates an expression again in every comparison.
    """
    return df.withColumn(_DRAW, hash_uniform(seed, *map(F.col, key)))


def shuffle(df: DataFrame, key: list[str], seed: int, name: str | None = None) -> DataFrame:
    """Rows in seeded random order; with ``name``, their place in it as a column."""
    drawn = with_draw(df, key, seed)
    placed = with_row_index(drawn, [_DRAW, *key], name) if name else drawn.orderBy(_DRAW, *key)
    return placed.drop(_DRAW)


def split_sizes(n: int, test_size: float | int | None = None, train_size: float | int | None = None) -> tuple[int, int]:
    """(n_train, n_test) with the range checks of the dataset library."""
    if test_size is None and train_size is None:
        test_size = 0.25
    for label, size in (("test_size", test_size), ("train_size", train_size)):
        whole = isinstance(size, int) and not 0 < size < n
        part = isinstance(size, float) and not 0 < size < 1
        if whole or part:
            raise ValueError(f"{label}={size} must be in (0, {n}) rows or a fraction in (0, 1)")
    if isinstance(train_size, float) and isinstance(test_size, float) and train_size + test_size > 1:
        raise ValueError("train_size and test_size add up to more than 1")
    n_test = math.ceil(test_size * n) if isinstance(test_size, float) else test_size
    n_train = math.floor(train_size * n) if isinstance(train_size, float) else train_size
    n_train = n - n_test if n_train is None else n_train
    n_test = n - n_train if n_test is None else n_test
    if n_train + n_test > n:
        raise ValueError(f"train and test need {n_train + n_test} of {n} rows")
    if n_train == 0:
        raise ValueError("the train split would be empty")
    return n_train, n_test


def _permutation_keys(drawn: DataFrame, order: list[str], positions) -> tuple[int, dict[int, Border]]:
    """``keys_at`` for the seeded permutation, without sorting all keys.

    Draws are uniform, so counting them in equal bins tells which bin holds a position; only that
    bin's keys, a ``DRAW_BINS``-th of all, are sorted.
    """
    bin_of = F.floor(F.col(_DRAW) * DRAW_BINS)
    counts = {r["bin"]: r["count"] for r in drawn.groupBy(bin_of.alias("bin")).count().collect()}
    total, found = sum(counts.values()), {}
    start = 0
    wanted = sorted({p for p in positions(total) if 0 <= p < total}) if total else []
    for number in sorted(counts):
        inside = [p for p in wanted if start <= p < start + counts[number]]
        if inside:
            # written first: a sort reads its input twice
            small = materialize(drawn.where(bin_of == number).select(*order), "bin")
            _, rows = keys_at(small, order, [p - start for p in inside])
            found.update({start + offset: border._replace(first=start + border.first) for offset, border in rows.items()})
        start += counts[number]
    return total, found


def train_test_split(df: DataFrame, key: list[str], test_size=None, train_size=None, shuffle: bool = True,
                     seed: int = 0, name: str = "split") -> DataFrame:
    """Rows labelled ``train`` or ``test`` in exact counts; surplus rows are dropped, no rows give empty splits.

    Only keys are looked at to find where the splits end; the rows themselves are labelled in
    place, by comparison with those keys, and are not moved.
    """
    drawn = with_draw(df, key, seed) if shuffle else df
    order = [_DRAW, *key] if shuffle else list(key)
    first, second = ("test", "train") if shuffle else ("train", "test")

    def ends(total: int) -> list[int]:
        n_train, n_test = split_sizes(total, test_size, train_size)
        return [n_test if shuffle else n_train, n_train + n_test]

    parted, total, _ = with_part(drawn, order, ends, "__part", _permutation_keys if shuffle else keys_at)
    if not total:
        return df.withColumn(name, F.lit(second)).limit(0)
    return parted.where("__part < 2").withColumn(name, F.when(F.col("__part") == 0, first).otherwise(second)).select(*df.columns, name)


def _quota(counts: DataFrame, label: str, weight: str, total: int, wanted: int, name: str) -> DataFrame:
    """Share ``wanted`` over the classes by largest remainder; the shares add up exactly.

    ``counts`` has one row per class, so the ranking window sees classes, not rows.
    """
    # floor and remainder in whole numbers: no rounding, also for very large classes
    exact = F.col(weight).cast("decimal(38,0)") * F.lit(wanted)
    shared = counts.withColumn(name, F.floor(exact / total).cast("long")).withColumn(
        "__rest", exact - F.col(name) * F.lit(total))
    missing = F.lit(wanted) - F.sum(name).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("__rest").desc(), label))
    return shared.withColumn(name, F.col(name) + F.when(place <= missing, 1).otherwise(0)).drop("__rest")


def train_test_split_stratified(df: DataFrame, label: str, key: list[str], test_size=None, train_size=None,
                                seed: int = 0, name: str = "split") -> DataFrame:
    """Exact split that keeps the class shares; every class needs two members, no rows give empty splits.

    Only the label and the keys are sorted, to find the two rows at which the splits of each class end. Rows are
    labelled in place by comparison with these; only where such a row's keys are repeated are all columns sorted.
    """
    drawn = with_draw(df, key, seed)
    order = [_DRAW, *[k for k in key if k != label]]
    narrow = with_group_index(drawn.select(label, *order), [label], order, "__pos")
    counts = materialize(narrow.groupBy(label).agg(F.count(F.lit(1)).alias("__n")), "classes")
    n, smallest = counts.agg(F.sum("__n"), F.min("__n")).first()
    if not n:
        return df.withColumn(name, F.lit("train")).limit(0)
    if smallest < 2:
        raise ValueError(f"a class of {label} with only 1 member cannot be in both splits")
    n_train, n_test = split_sizes(n, test_size, train_size)
    quotas = _quota(counts, label, "__n", n, n_test, "__test")
    left = quotas.withColumn("__left", F.col("__n") - F.col("__test"))
    quotas = _quota(left, label, "__left", n - n_test, n_train, "__train")
    quotas = materialize(quotas.select(
        F.col(label).alias("__label"), F.col("__test"), (F.col("__test") + F.col("__train")).alias("__end")), "quotas")
    of_class = F.col(label).eqNullSafe(F.col("__label"))
    at = lambda place: F.max(F.when(F.col("__pos") == F.col(place), F.struct(*order)))
    # per class the keys of the first row behind each split, null if there is none; a row earlier in the class must not have them
    ends = narrow.join(quotas, of_class).where(
        F.col("__pos").isin(F.col("__test"), F.col("__end"), F.col("__test") - 1, F.col("__end") - 1)).groupBy("__label").agg(
        at("__test").alias("__first"), at("__end").alias("__last"),
        F.max(F.when(F.col("__pos") == F.col("__test") - 1, F.struct(*order))).alias("__before_first"),
        F.max(F.when(F.col("__pos") == F.col("__end") - 1, F.struct(*order))).alias("__before_last"))
    ends = materialize(ends, "ends")
    tied = ends.where(F.expr("__first <=> __before_first and __first is not null or __last <=> __before_last and __last is not null"))
    if not tied.isEmpty():
        placed = with_group_index(drawn, [label], order, "__pos")
        part = F.col("__pos") < F.col("__test")
        return placed.join(quotas, of_class).where(F.col("__pos") < F.col("__end")).withColumn(
            name, F.when(part, "test").otherwise("train")).select(*df.columns, name)
    here = F.struct(*order)
    earlier = lambda end: F.col(end).isNull() | (here < F.col(end))
    # null in __first: the whole class is in the test split
    return drawn.join(ends, of_class).where(earlier("__last")).withColumn(
        name, F.when(earlier("__first"), "test").otherwise("train")).select(*df.columns, name)
