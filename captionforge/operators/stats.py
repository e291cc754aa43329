"""Per-class feature statistics, Frechet distance, and metric series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.operators.positions import with_group_index
from captionforge.session import materialize

ROWS_PER_CHUNK = 65536  # vectors one task sums for one class before merging
HELD_SUMS = 1 << 22     # sums that a task holds for class means
HELD_BYTES = 64 << 20   # moments of all classes that a task holds
PARTIALS = 64           # partial sums that are merged at once


def unique(df: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct values with the order key of their first appearance; null is a value."""
    return df.groupBy(name).agg(F.min(order).alias("first_seen"))


def _by_label(labels: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct labels of a batch (None is one) and each row's number among them."""
    coded = labels.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def class_mean(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, i, n, mean): mean vector per class, one row per dimension; null elements do not count.

    Sums are filled where the vectors are read: a task passes on a row per class and dimension, or several where
    classes times dimensions exceed ``HELD_SUMS``.
    """
    kind = df.schema[label].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, (count, total) in held.items():
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(some), schema.field(0).type), pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some])], schema=schema)
            held.clear()

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("label", batch.schema.field(0).type), ("i", pa.int32()), ("n", pa.int64()), ("total", pa.float64())])
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
            if not sizes.sum():
                continue
            width, x = int(sizes.max()), batch.column(1).flatten()
            sound = x.is_valid().to_numpy(zero_copy_only=False)
            place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            names, code = _by_label(batch.column(0))
            cell = (np.repeat(code, sizes) * width + place)[sound]
            count = np.bincount(cell, minlength=len(names) * width).reshape(-1, width)
            total = np.bincount(cell, x.drop_null().to_numpy(zero_copy_only=False).astype(np.float64), len(names) * width).reshape(-1, width)
            for name, n, t in zip(names, count, total):
                if name in held:
                    a, b = held[name]
                    longer = max(len(a), width)
                    held[name] = [np.pad(u, (0, longer - len(u))) + np.pad(v, (0, longer - width)) for u, v in ((a, n), (b, t))]
                else:
                    held[name] = [n, t]
            if sum(len(a) for a, _ in held.values()) > HELD_SUMS:
                yield from rows()
        yield from rows()

    sums = df.select(F.col(label).alias("label"), F.col(vector).alias("v")).mapInArrow(partial, f"label {kind}, i int, n bigint, total double")
    return sums.groupBy(F.col("label").alias(label), "i").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))


def _chunked(df: DataFrame, label: str, key: list[str], rows_per_chunk: int) -> tuple[DataFrame, int]:
    """Add ``__chunk``: a class is cut into chunks of bounded size by the hash of the row key.

    Also returns the largest number of chunks of any class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    chunks = materialize(counts.select(
        F.col(label).alias("__label"), F.ceil(F.col("__n") / rows_per_chunk).alias("__chunks")), "chunks")
    most = chunks.agg(F.max("__chunks")).first()[0] or 1
    salted = df.join(chunks, F.col(label).eqNullSafe(F.col("__label")))
    pick = F.floor(hash_uniform("chunk", *map(F.col, key)) * F.col("__chunks")).cast("int")
    return salted.withColumn("__chunk", pick).drop("__label", "__chunks"), most


def _runs(keys: pd.DataFrame) -> np.ndarray:
    """Start offsets of the runs of equal rows."""
    codes = keys.apply(lambda c: pd.factorize(c, use_na_sentinel=False)[0]).to_numpy()
    return np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])


def _merge_rows(by: list[str]):
    """Add up rows of equal keys (class, matrix row, ...), which arrive next to each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for batch in batches:
            if batch.empty:
                continue
            rows = batch[[*by, "n", "total", "cross"]]
            rows = rows if carry is None else pd.concat([carry, rows], ignore_index=True)
            starts = _runs(rows[by])
            out = rows.iloc[starts][by].reset_index(drop=True)
            out["n"] = np.add.reduceat(rows["n"].to_numpy(), starts)
            out["total"] = np.add.reduceat(rows["total"].to_numpy(), starts)
            out["cross"] = list(np.add.reduceat(np.stack(rows["cross"].to_numpy()), starts, axis=0))
            # the last run may go on in the next batch
            yield out.iloc[:-1]
            carry = out.iloc[-1:]
        if carry is not None:
            yield carry

    return run


def class_moments(df: DataFrame, label: str, vector: str, key: list[str], shift: list[float], rows_per_chunk: int = ROWS_PER_CHUNK,
                  held_bytes: int = HELD_BYTES) -> DataFrame:
    """(label, i, n, total, cross): shifted sums per class, one row per matrix row.

    Where the matrices of all classes fit into ``held_bytes``, every task fills them while it reads the vectors, and
    only these sums are exchanged, and merged in two levels. With more classes or longer vectors a task would
    pass on more numbers in matrices than it has read; then vectors are dealt by class instead, and a class is
    cut into chunks of ``rows_per_chunk``. Either way no task holds a class or merges a whole matrix. Shifting
    all vectors by one common vector keeps the sums well conditioned and still additive.
    """
    width = len(shift)
    each = 8 * width * (width + 1)
    most = held_bytes // each if width else 0
    classes = df.select(label).distinct().limit(most + 1).count()
    if width and classes <= most:
        return _moments_where_read(df, label, vector, np.asarray(shift)).withColumnRenamed("__label", label)
    return _moments_by_class(df, label, vector, key, np.asarray(shift), rows_per_chunk).withColumnRenamed("__label", label)


def _merged(partials: DataFrame, by: list[str]) -> DataFrame:
    return partials.repartition(*by).sortWithinPartitions(*by).mapInPandas(_merge_rows(by), partials.select(*by, "n", "total", "cross").schema)


def _moments_where_read(df: DataFrame, label: str, vector: str, centre: np.ndarray) -> DataFrame:
    width = len(centre)
    kind = df.schema[label].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, code = _by_label(batch.column(0))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) - centre
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            for name, lo, hi in zip(names, cuts, cuts[1:]):
                own = x[order[lo:hi]]
                sums = [hi - lo, own.sum(axis=0), own.T @ own]
                held[name] = [a + b for a, b in zip(held[name], sums)] if name in held else sums
        task = TaskContext.get().partitionId()
        for name, (n, total, cross) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * width, batch.schema.field(0).type), pa.array(np.arange(width), pa.int32()), pa.array([n] * width, pa.int64()),
                pa.array(total), pa.array(list(cross), pa.list_(pa.float64())), pa.array([task] * width, pa.int32())],
                ["__label", "i", "n", "total", "cross", "task"])

    # rows without a label are a class; a null vector is no vector
    narrow = df.where(F.col(vector).isNotNull()).select(F.col(label).alias("__label"), F.col(vector).alias("__v"))
    schema = f"__label {kind}, i int, n long, total double, cross array<double>, task int"
    partials = narrow.mapInArrow(fill, schema).withColumn("part", F.floor(F.col("task") / PARTIALS))
    # the sums of some tasks at a time, in case there are very many
    return _merged(_merged(partials, ["__label", "i", "part"]), ["__label", "i"])


def _moments_by_class(df: DataFrame, label: str, vector: str, key: list[str], centre: np.ndarray, rows_per_chunk: int) -> DataFrame:
    width = len(centre)
    schema = f"__label {df.schema[label].dataType.simpleString()}, i int, n long, total double, cross array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows_of(key, n, total, cross) -> pd.DataFrame:
            return pd.DataFrame({"__label": [key[0]] * width, "i": np.arange(width, dtype="int32"), "n": n,
                                 "total": total, "cross": list(cross)})

        open_key, open_sums = None, None
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["__v"].to_numpy()).astype(np.float64) - centre
            starts = _runs(batch[["__label", "__chunk"]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(batch)]):
                # rows arrive sorted by class and chunk, so a new key closes the one before
                group = (batch["__label"].iloc[lo], batch["__chunk"].iloc[lo])
                part = x[lo:hi]
                sums = [hi - lo, part.sum(axis=0), part.T @ part]
                if open_sums is not None and _same(group, open_key):
                    open_sums = [a + b for a, b in zip(open_sums, sums)]
                    continue
                if open_sums is not None:
                    yield rows_of(open_key, *open_sums)
                open_key, open_sums = group, sums
        if open_sums is not None:
            yield rows_of(open_key, *open_sums)

    chunked, most = _chunked(df.select(F.col(label), F.col(vector).alias("__v"), *[k for k in key if k != label]),
                             label, key, rows_per_chunk)
    ordered = chunked.select(F.col(label).alias("__label"), "__chunk", "__v").repartition(
        "__label", "__chunk").sortWithinPartitions("__label", "__chunk")
    partials = ordered.mapInPandas(partial, schema)
    if most > 1:
        partials = _merged(partials, ["__label", "i"])
    return partials


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def pooled_mean(df: DataFrame, vector: str) -> list[float]:
    """Mean over all vectors: one partial sum per task, one number per dimension on the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                n, total = n + len(x), x.sum(axis=0) + (0.0 if total is None else total)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total]})

    sums = df.select(F.col(vector).alias("v")).mapInPandas(partial, "n long, total array<double>")
    rows = sums.select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg(
        (F.sum("x") / F.sum("n")).alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["i"])]


def class_stats(df: DataFrame, label: str, vector: str, key: list[str], rows_per_chunk: int = ROWS_PER_CHUNK,
                held_bytes: int = HELD_BYTES) -> DataFrame:
    """(label, n, mu, sigma): mean vector and sample covariance matrix per class."""
    shift = pooled_mean(df, vector)
    moments = class_moments(df, label, vector, key, shift, rows_per_chunk, held_bytes)
    # one class's matrix: width x width numbers, the size of the result itself
    rows = F.array_sort(F.collect_list(F.struct("i", "total", "cross")))
    grouped = moments.groupBy(label).agg(F.first("n").alias("n"), rows.alias("__rows"))
    n = F.col("n").cast("double")
    totals = F.col("__rows")["total"]
    mu = F.zip_with(totals, F.array(*map(F.lit, shift)), lambda t, c: t / n + c)

    def cov_row(r: Column) -> Column:
        return F.zip_with(r["cross"], totals, lambda c, t: F.try_divide(c - r["total"] * t / n, n - 1))

    return grouped.select(label, "n", mu.alias("mu"), F.transform("__rows", cov_row).alias("sigma"))


def class_cov(stats: DataFrame, label: str) -> DataFrame:
    """The covariance matrices in long form: (label, i, j, cov)."""
    rows = stats.select(label, F.posexplode("sigma").alias("i", "__row"))
    return rows.select(label, "i", F.posexplode("__row").alias("j", "cov"))


def frechet(mu1, sigma1, mu2, sigma2) -> float:
    """|mu1 - mu2|^2 + tr(S1 + S2 - 2 (S1 S2)^(1/2)), by symmetric eigenvalues."""
    mu1, mu2 = np.asarray(mu1), np.asarray(mu2)
    s1, s2 = np.stack(sigma1), np.stack(sigma2)
    values, vectors = np.linalg.eigh((s1 + s1.T) / 2)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    inner = root @ s2 @ root
    cross = np.sqrt(np.clip(np.linalg.eigvalsh((inner + inner.T) / 2), 0, None)).sum()
    return float(((mu1 - mu2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2.0 * cross)


def frechet_distance(real: DataFrame, generated: DataFrame, label: str) -> DataFrame:
    """(label, distance) for classes in both statistics tables; one row per class in each."""
    pairs = real.select(label, F.col("mu").alias("mu1"), F.col("sigma").alias("s1")).join(
        generated.select(label, F.col("mu").alias("mu2"), F.col("sigma").alias("s2")), label)

    @F.pandas_udf("double")
    def distance(mu1: pd.Series, s1: pd.Series, mu2: pd.Series, s2: pd.Series) -> pd.Series:
        return pd.Series([frechet(*row) for row in zip(mu1, s1, mu2, s2)])

    return pairs.select(label, distance("mu1", "s1", "mu2", "s2").alias("distance"))


# ---- metric series ----

def step_mean(df: DataFrame, step: str, value: str, log_steps: int, accumulation: int = 1) -> DataFrame:
    """Mean of a metric per ``log_steps`` updates of ``accumulation`` micro-steps."""
    window = F.floor(F.col(step) / (log_steps * accumulation)).alias("log_window")
    return df.groupBy(window).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"))


def _compose(rows: DataFrame, group: list[str], width: int, level: int, top: int) -> DataFrame:
    """Prefix-compose the affine steps e -> a*e + b in position order.

    Input and output columns: group, pos, a, b. Steps are composed inside blocks of ``width``
    positions, block totals are composed one level up, and each block is completed with
    the prefix of the blocks before it. A block is the largest thing a task holds.
    """
    block = F.floor(F.col("pos") / width) if level < top else F.lit(0).cast("long")
    steps = F.array_sort(F.collect_list(F.struct("pos", "a", "b")))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast(
        "array<struct<pos:bigint,a:double,b:double>>").alias("out"))

    def push(acc: Column, x: Column) -> Column:
        a, b = acc["a"] * x["a"], acc["b"] * x["a"] + x["b"]
        return F.struct(a.alias("a"), b.alias("b"), F.concat(
            acc["out"], F.array(F.struct(x["pos"].alias("pos"), a.alias("a"), b.alias("b")))).alias("out"))

    folded = rows.groupBy(*group, block.alias("__block")).agg(steps.alias("__steps")).select(
        *group, "__block", F.aggregate("__steps", start, push).alias("__f"))
    inner = folded.select(*group, "__block", F.explode("__f.out").alias("__s")).select(
        *group, "__block", "__s.pos", "__s.a", "__s.b")
    if level == top:
        return inner.drop("__block")
    totals = folded.select(*group, F.col("__block").alias("pos"), F.col("__f.a").alias("a"), F.col("__f.b").alias("b"))
    before = _compose(totals, group, width, level + 1, top).select(
        *[F.col(g).alias(f"__g_{g}") for g in group], (F.col("pos") + 1).alias("__next"),
        F.col("a").alias("__a0"), F.col("b").alias("__b0"))
    same = F.col("__block") == F.col("__next")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    a0, b0 = F.coalesce("__a0", F.lit(1.0)), F.coalesce("__b0", F.lit(0.0))
    return inner.join(before, same, "left").select(
        *group, "pos", (a0 * F.col("a")).alias("a"), (b0 * F.col("a") + F.col("b")).alias("b"))


def ema_series(df: DataFrame, group: list[str], order_by: list[str], value: str, decay: float, every: int = 1,
               width: int = 64) -> DataFrame:
    """(group, pos, ema): exponential moving average of every ``every``-th value per key.

    The first value starts the average. A key's series is not walked by one task: the
    recurrence is an affine map per value, and maps compose in blocks (see ``_compose``).
    """
    placed = with_group_index(df.select(*group, *order_by, value), group, order_by, "__pos")
    kept = placed.where(F.col("__pos") % every == 0).withColumn("pos", F.floor(F.col("__pos") / every))
    first = F.col("pos") == 0
    x = F.col(value).cast("double")
    steps = materialize(kept.select(
        *group, "pos",
        F.when(first, 0.0).otherwise(F.lit(decay)).alias("a"),
        F.when(first, x).otherwise((1.0 - decay) * x).alias("b"),
    ), "ema")
    longest = steps.agg(F.max("pos")).first()[0] or 0
    top = 0
    while longest >= width:
        longest //= width
        top += 1
    return _compose(steps, group, width, 0, top).select(*group, "pos", F.col("b").alias("ema"))
