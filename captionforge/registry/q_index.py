"""Searches through written indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.operators import vector_index
from captionforge.registry import query, table
from captionforge.session import scratch_path

_EVERY_20TH = """SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, {score}(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)) WHERE rank <= 10"""


def _search(spark, sf_dir, **options):
    """Every twentieth vector as a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vector-index")
    vector_index.write_index(vectors, path, "vec_id", "embedding", cells=64)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.search_index(spark, path, asked, 10, "query_id", "embedding", "vec_id", **options)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("knn_index")
def knn_index(spark, sf_dir):
    return _search(spark, sf_dir, probes=24)


@query("knn_index_exact", _EVERY_20TH.format(score="list_distance", order="ASC"))
def knn_index_exact(spark, sf_dir):
    return _search(spark, sf_dir, probes=8, exact=True)


@query("knn_index_exact_inner_product", _EVERY_20TH.format(score="list_inner_product", order="DESC"))
def knn_index_exact_inner_product(spark, sf_dir):
    return _search(spark, sf_dir, probes=8, exact=True, metric="inner_product")
