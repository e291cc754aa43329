"""Exact nearest-neighbour search and BM25 text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionforge.operators.positions import with_row_index
from captionforge.operators.text_index import K1, B, SLACK, analyse, count_words, in_block, query_blocks, still_best, term_weights
from captionforge.session import materialize, scratch_path, small_batches

QUERY_BLOCK_BYTES = 32 << 20  # vectors of one query block, as doubles, sent to every task
SCORE_CELLS = 1 << 22  # query x base scores a task holds at once
SCORE_PAIRS = 1 << 14  # candidate pairs scored exactly at once


def _top_k(scored: DataFrame, query_id: str, k: int, order: list, rank: str = "rank") -> DataFrame:
    """k best rows per query; Spark trims each task's rows to k before the shuffle."""
    best = Window.partitionBy(query_id).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def _best(found: pd.DataFrame, k: int, smallest: bool) -> pd.DataFrame:
    """k best candidates per query; equal scores go to the smaller id, whatever the layout."""
    ordered = found.sort_values(["q", "score", "id"], ascending=[True, smallest, True])
    return ordered.groupby("q", sort=False).head(k)


def _search_block(base: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str, out_schema: str,
                  query_id: str, base_id: str) -> DataFrame:
    """Per-task top k of the base vectors for every query of one block."""
    shared = base.sparkSession.sparkContext.broadcast((ids, matrix))
    smallest = metric == "l2"

    def candidates(x: np.ndarray, q: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that can still be among the k best, by a matrix product.

        Squared distances from a product carry rounding error; pairs within a margin far
        above it are kept, and scored exactly afterwards.
        """
        if smallest:
            squares = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
            cost, margin = squares - 2.0 * (q @ x.T), 1e-9 * squares
            limit = worst**2
        else:
            cost = -(q @ x.T)
            margin, limit = 1e-9 * np.abs(cost), -worst
        if x.shape[0] > k:
            limit = np.minimum(limit, np.partition(cost, k - 1, axis=1)[:, k - 1])
        return np.nonzero(cost <= limit[:, None] + 2 * margin + 2 * margin.max(initial=0.0, where=np.isfinite(margin)))

    def best_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        step = max(SCORE_CELLS // len(q), 1)
        worst = np.full(len(q), np.inf if smallest else -np.inf)
        best = None
        for batch in batches:
            if batch.empty:
                continue
            names, vectors = batch[base_id].to_numpy(), np.stack(batch["__v"].to_numpy()).astype(np.float64)
            for start in range(0, len(batch), step):
                x = vectors[start:start + step]
                # a vector with a number that is not finite has no distance: it is no neighbour and hides none
                sound = np.isfinite(x).all(axis=1)
                x, kept = x[sound], names[start:start + step][sound]
                if not len(x):
                    continue
                qi, xi = candidates(x, q, worst)
                score = np.empty(len(qi))
                for lo in range(0, len(qi), SCORE_PAIRS):
                    part = slice(lo, lo + SCORE_PAIRS)
                    a, b = x[xi[part]], q[qi[part]]
                    score[part] = np.sqrt(((a - b) ** 2).sum(axis=1)) if smallest else (a * b).sum(axis=1)
                found = pd.DataFrame({"q": qi, "id": kept[xi], "score": score})
                best = _best(found if best is None else pd.concat([best, found]), k, smallest)
                full = best.groupby("q")["score"].agg(["size", "max" if smallest else "min"])
                full = full[full["size"] == k]
                worst[full.index] = full.iloc[:, 1]
        if best is not None:
            yield pd.DataFrame({query_id: q_ids[best["q"].to_numpy()], base_id: best["id"].to_numpy(),
                                "score": best["score"].to_numpy()})

    return base.mapInPandas(best_of, out_schema)


def knn_search(base: DataFrame, queries: DataFrame, k: int, base_id: str, base_vector: str, query_id: str,
               query_vector: str, metric: str = "l2") -> DataFrame:
    """(query, base, score, rank): the k nearest base vectors of each query, exactly.

    Vectors with a NaN or an infinity are nobody's neighbours, and such a query has none.

    Every task scans its share of the base against a block of queries and passes on k rows
    per query. The block's size is bounded in bytes; more queries make more passes over
    the base, each written out before the next, so nothing grows with the query count.
    """
    if metric not in ("l2", "inner_product"):
        raise ValueError("metric is l2 or inner_product")
    spark = base.sparkSession
    id_type = base.schema[base_id].dataType.simpleString()
    q_type = queries.schema[query_id].dataType.simpleString()
    schema = f"{query_id} {q_type}, {base_id} {id_type}, score double"
    narrow = base.select(base_id, F.col(base_vector).alias("__v"))
    wanted = queries.select(F.col(query_id), F.col(query_vector).cast("array<double>").alias("__q"))
    wanted = wanted.where(~F.exists("__q", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    width = wanted.agg(F.max(F.size("__q"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema + ", rank int")
    per_block = max(QUERY_BLOCK_BYTES // (8 * width), 1)
    order = [F.col("score").asc() if metric == "l2" else F.col("score").desc(), base_id]

    def run(block: DataFrame) -> DataFrame:
        rows = block.toPandas()
        found = _search_block(narrow, rows[query_id].to_numpy(), np.stack(rows["__q"].to_numpy()), k, metric,
                              schema, query_id, base_id)
        return _top_k(found, query_id, k, order)

    n_queries = wanted.count()
    if n_queries <= per_block:
        return run(wanted)
    numbered = with_row_index(wanted, [query_id], "__no")
    path = scratch_path(spark, "neighbours")
    for start in range(0, n_queries, per_block):
        block = numbered.where(F.col("__no").between(start, start + per_block - 1)).drop("__no")
        run(block).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _scored(counted: DataFrame, asked: pa.Table, mean_len: float, k: int, doc_kind: str, query_id: str, doc_id: str, query_kind: str) -> DataFrame:
    """(query, doc, score) of the documents that can be among the k best, from rows (doc, len, terms, counts) where they are read."""
    ids, terms, term, query = term_weights(asked)
    weights = np.zeros((len(terms), len(ids)))
    np.add.at(weights, (term, query), asked.column("idf").to_numpy())
    shared = counted.sparkSession.sparkContext.broadcast((ids, terms, weights))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, words, idf = shared.value
        v, q = idf.shape
        step = max(SCORE_CELLS // (4 * max(v, q)), 1)  # a few such matrices are held
        best = np.full((q, k), -np.inf)
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            n, held = batch.num_rows, batch.column(2)
            at = pc.index_in(held.flatten(), value_set=words)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[known]
            # rows of one document are one here: its counts of a term are added
            tf = np.bincount(row * v + at.drop_null().to_numpy(), batch.column(3).flatten().to_numpy()[known], n * v).reshape(n, v)
            norm = K1 * (1.0 - B + B * batch.column(1).fill_null(0).to_numpy() / mean_len)
            score = (tf * (K1 + 1.0) / (tf + norm[:, None])) @ idf
            best, kept = still_best(best, score)
            doc, query = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), batch.column(0).take(pa.array(doc)), pa.array(score[doc, query])], [query_id, doc_id, "score"])

    found = counted.select("doc", "len", "terms", "counts").mapInArrow(best_of, f"{query_id} {query_kind}, {doc_id} {doc_kind}, score double")
    return found.withColumn("score", F.round("score", 6))


def text_search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str, text: str, query_id: str,
                query_text: str) -> DataFrame:
    """(query, doc, score, rank): BM25 top k over whole texts.

    Words are counted where a document is read, and its counts dealt once, a row per document. A block of queries is
    scored as a product of matrices where the counts are read, and k rows a query of each task go on: no pair of a
    document and a query is shuffled. The block's size is bounded in bytes; more queries make more passes over the counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(analyse(F.col(query_text)))).alias("term"))
    doc_kind, query_kind = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    split = docs.select(F.col(doc_id).alias("doc"), analyse(F.col(text)).alias("words"))
    rows = materialize(split.mapInArrow(count_words, f"doc {doc_kind}, len bigint, terms array<string>, counts array<bigint>"), "counts")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len")).first()
    # only ids that occur more than once are dealt: their rows are one document
    several = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc").alias("again"))
    several = materialize(several, "repeated-ids")
    same = F.col("doc").eqNullSafe(F.col("again"))
    joined = rows.join(several, same, "left_semi").groupBy("doc").agg(F.first("len").alias("len"), *[
        F.flatten(F.collect_list(c)).alias(c) for c in ("terms", "counts")])
    counted = rows.join(several, same, "left_anti").unionByName(joined)
    terms = counted.select(F.explode(F.array_distinct("terms")).alias("term"))
    df = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.lit(sizes["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = materialize(asked.join(df, "term").select("query", "term", idf.alias("idf")), "weights")
    blocks = query_blocks(weighted, QUERY_BLOCK_BYTES)
    if not blocks:
        return spark.createDataFrame([], f"{query_id} {query_kind}, {doc_id} {doc_kind}, score double, rank int")
    order = [F.col("score").desc(), doc_id]

    def run(block: DataFrame) -> DataFrame:
        scored = _scored(counted, block.toArrow(), sizes["mean_len"], k, doc_kind, query_id, doc_id, query_kind)
        return _top_k(scored, query_id, k, order)

    if blocks == 1:
        return run(weighted)
    path = scratch_path(spark, "found")
    for b in range(blocks):
        block = weighted.where(in_block(b, blocks))
        if not block.isEmpty():
            run(block).write.mode("append").parquet(path)
    return spark.read.parquet(path)
