"""An inverted file of vectors: cells around fitted centres, written once, of which a search reads a few.

1. Centres come from Lloyd rounds over a sample of ``PER_CELL`` vectors per cell. Their number is bounded by
   ``CENTRE_BYTES``, because every task holds them; everything else grows with the data only on disk.
2. Every vector goes to its nearest centre's cell. A cell is written as rows of at most ``BLOCK`` vectors, by as many
   tasks as its size asks for, under a partition folder of its own.
3. A search gives each query its ``probes`` nearest cells, groups the queries of a cell into blocks, and joins them with
   that cell's rows: one matrix product per pair of blocks, k rows per query from each. Other cells are not read.
4. With ``exact``, the k-th best of that search bounds what other cells can hold (distance to the centre less
   the cell's radius), and only the cells that may still hold a better vector are read too.

Vectors with a null, a NaN or an infinity are nobody's neighbours and are not in the index; such a query finds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.session import materialize, small_batches

PER_CELL = 64               # sampled vectors per centre
ROUNDS = 8
CENTRE_BYTES = 64 << 20
BLOCK = 1024                # vectors in a row of the index
ROWS_PER_TASK = 1 << 18     # vectors of a cell that one task writes
QUERY_BLOCK = 256           # queries compared at once with a row of the index
VISIT_BYTES = 8 << 20       # of queries, once for each cell they may visit, passed on at once
SCORE_PAIRS = 1 << 14       # pairs scored exactly at once
MARGIN = 1e-9               # relative rounding error allowed for


def _finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2.0 * (x @ centres.T), 0)


def fit_centres(base: DataFrame, key: str, vector: str, cells: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``cells`` cells, or of as many as there are vectors; fitted on about ``PER_CELL`` vectors each."""
    sound = base.where(_finite(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n = sound.count()
    if not n:
        return np.zeros((0, 0))
    drawn = sound.withColumn("draw", hash_uniform(seed, F.col("key")))
    sample = materialize(drawn.where(F.col("draw") < PER_CELL * cells / n), "sample")
    width = sample.select(F.size("v")).first()[0]
    if 8 * width * cells > CENTRE_BYTES:
        raise ValueError(f"{cells} centres of {width} numbers need more than {CENTRE_BYTES} bytes in every task")
    first = sample.orderBy("draw", "key").limit(cells).select("v").toArrow()
    centres = np.unique(_matrix(first.column(0)), axis=0)

    for _ in range(rounds):
        held = sample.sparkSession.sparkContext.broadcast(centres)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle = held.value
            total, count = np.zeros_like(middle), np.zeros(len(middle), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    cell = _squares(x, middle).argmin(axis=1)
                    np.add.at(total, cell, x)
                    count += np.bincount(cell, minlength=len(middle))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": rows["cell"].iloc[:1], "centre": [np.stack(rows["total"]).sum(axis=0) / rows["n"].sum()]})

        sums = sample.select("v").mapInArrow(partial, "cell int, n bigint, total array<double>")
        moved = centres.copy()
        for r in sums.groupBy("cell").applyInPandas(merge, "cell int, centre array<double>").collect():
            moved[r["cell"]] = r["centre"]
        held.unpersist()
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def write_index(base: DataFrame, path: str, key: str, vector: str, cells: int = 256, seed: int = 0) -> None:
    """Write the index of all vectors below ``path``: ``blocks`` by cell, and ``centres``, which comes last."""
    spark = base.sparkSession
    centres = fit_centres(base, key, vector, cells, seed)
    held = spark.sparkContext.broadcast(centres)
    kind = base.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            squares = _squares(x, held.value)
            cell = squares.argmin(axis=1)
            away = np.sqrt(((x - held.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(away)], ["key", "v", "cell", "away"])

    narrow = base.where(_finite(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    placed = materialize(narrow.mapInArrow(assign, f"key {kind}, v array<double>, cell int, away double"), "cells")
    sizes = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")), "cell-sizes")
    parts = sizes.select("cell", F.ceil(F.col("n") / ROWS_PER_TASK).alias("parts"))
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.select("cell", "part", "key", "v").repartition("cell", "part").sortWithinPartitions("cell", "part", "key")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one cell next to each other, up to BLOCK of them, become one row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, keys, x = batch.column(0).to_numpy(), batch.column(1), _matrix(batch.column(2))
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            cuts = sorted({c for lo, hi in zip(starts, np.append(starts[1:], len(cell))) for c in range(lo, hi, BLOCK)})
            ends = [*cuts[1:], len(cell)]
            yield pa.RecordBatch.from_arrays([
                pa.array(cell[cuts], pa.int32()), pa.ListArray.from_arrays(pa.array([*cuts, len(cell)], pa.int32()), keys),
                pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["cell", "keys", "vectors"])

    blocks = dealt.select("cell", "key", "v").mapInArrow(block, f"cell int, keys array<{kind}>, vectors binary")
    blocks.write.partitionBy("cell").parquet(f"{path}/blocks")
    # one small table: a row per cell
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    # the empty column tells the type of the keys, also of an index without vectors
    known.join(sizes, "cell").withColumn("key", F.lit(None).cast(kind)).write.parquet(f"{path}/centres")


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1)) if metric == "l2" else (x * q).sum(axis=1)


def _pair_best(x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors of each query, scored exactly; the first of equal ones."""
    if metric == "l2":
        squares = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)
        cost, error = squares - 2.0 * (q @ x.T), MARGIN * squares.max(axis=1)
    else:
        cost = -(q @ x.T)
        error = MARGIN * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max())
    limit = np.partition(cost, k - 1, axis=1)[:, k - 1] if x.shape[0] > k else np.full(len(q), np.inf)
    qi, xi = np.nonzero(cost <= (limit + 2 * error)[:, None])
    score = np.empty(len(qi))
    for lo in range(0, len(qi), SCORE_PAIRS):
        part = slice(lo, lo + SCORE_PAIRS)
        score[part] = _scores(x[xi[part]], q[qi[part]], metric)
    # many equal vectors give no more than k rows a query
    order = np.lexsort((xi, score if metric == "l2" else -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    kept = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[kept], xi[kept], score[kept]


def _compare(pairs: DataFrame, k: int, metric: str, query_id: str, base_id: str, q_kind: str, kind: str) -> DataFrame:
    """k rows per query from each row (keys, vectors, query ids, query vectors), of which a task holds a few."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors, asked, wanted = batch.columns
            for i in range(batch.num_rows):
                names, queries = keys[i].values, asked[i].values
                x = np.frombuffer(vectors[i].as_py(), np.float64).reshape(len(names), -1)
                qi, xi, score = _pair_best(x, _matrix(wanted[i].values), k, metric)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(qi)), names.take(pa.array(xi)), pa.array(score)], [query_id, base_id, "score"])

    return pairs.select("keys", "vectors", "asked", "wanted").mapInArrow(run, f"{query_id} {q_kind}, {base_id} {kind}, score double")


def _top(found: DataFrame, k: int, metric: str, query_id: str, base_id: str) -> DataFrame:
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    best = Window.partitionBy(query_id).orderBy(order, base_id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, query_id: str, query_vector: str, base_id: str = "id",
                 probes: int = 16, metric: str = "l2", exact: bool = False) -> DataFrame:
    """(query, base, score, rank): the k nearest vectors of the ``probes`` nearest cells of each query, or with ``exact`` of all.

    For ``inner_product`` the nearest cells are those whose centres have the largest products.
    """
    if metric not in ("l2", "inner_product"):
        raise ValueError("metric is l2 or inner_product")
    centres = spark.read.parquet(f"{path}/centres")
    cells, kind = centres.orderBy("cell").toArrow(), centres.schema["key"].dataType.simpleString()
    q_kind = queries.schema[query_id].dataType.simpleString()
    if not cells.num_rows:
        return spark.createDataFrame([], f"{query_id} {q_kind}, {base_id} {kind}, score double, rank int")
    blocks = spark.read.parquet(f"{path}/blocks")
    held = spark.sparkContext.broadcast((cells.column("cell").to_numpy(), _matrix(cells.column("centre")), cells.column("radius").to_numpy()))
    asked = queries.where(_finite(query_vector)).select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))

    def visits(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, centres, radius = held.value
            step = max(1, VISIT_BYTES // max(1, centres.nbytes))
            for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
                x = _matrix(batch.column(1))
                if metric == "l2":
                    rank = np.sqrt(_squares(x, centres))
                    best = np.maximum(rank - radius, 0)
                else:
                    rank = -(x @ centres.T)
                    best = rank - np.sqrt((x**2).sum(axis=1))[:, None] * radius
                near = np.zeros(rank.shape, dtype=bool)
                np.put_along_axis(near, np.argsort(rank, axis=1, kind="stable")[:, :probes], True, axis=1)
                if second:
                    # rounding must not hide a cell; a query with too few neighbours so far visits all
                    bound = batch.column(2).to_numpy(zero_copy_only=False)
                    slack = MARGIN * (np.abs(rank) + radius + 1) + 1e-7 * np.sqrt((x**2).sum(axis=1))[:, None]
                    near = ~near & ~(best - slack > np.where(np.isnan(bound), np.inf, bound)[:, None])
                row, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(numbers[cell], pa.int32())], ["q", "v", "cell"])

        return run

    def visit(rows: DataFrame, second: bool) -> DataFrame:
        wanted = materialize(rows.mapInArrow(visits(second), f"q {q_kind}, v array<double>, cell int"), "visits")
        counts = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("parts"))
        # as many numbers as there are cells
        read = [r["cell"] for r in counts.select("cell").collect()]
        dealt = wanted.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
        grouped = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("q", "v")).alias("rows"))
        grouped = grouped.select("cell", F.col("rows.q").alias("asked"), F.col("rows.v").alias("wanted"))
        # the index does not pass through the driver, whatever its size
        return _compare(blocks.where(F.col("cell").isin(read)).join(grouped.hint("merge"), "cell"), k, metric, query_id, base_id, q_kind, kind)

    found = _top(visit(asked, False), k, metric, query_id, base_id)
    if not exact:
        return found
    found = materialize(found, "probed")
    worst = found.where(F.col("rank") == k).select(F.col(query_id).alias("q"), (F.col("score") if metric == "l2" else -F.col("score")).alias("bound"))
    more = visit(asked.join(worst, "q", "left").select("q", "v", "bound"), True)
    return _top(found.drop("rank").union(more), k, metric, query_id, base_id)
