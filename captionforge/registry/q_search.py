"""Nearest neighbours and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.operators import search, text_index
from captionforge.operators.stats import class_mean
from captionforge.registry import query, table
from captionforge.session import scratch_path

_CENTRES = """c AS MATERIALIZED (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS m
  FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"""


def _knn_sql(score: str, order: str) -> str:
    return f"""WITH {_CENTRES}, s AS (SELECT label AS query_id, vec_id, {score} AS score FROM embeddings e, c WHERE true)
  SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id) AS rank FROM s) WHERE rank <= 10""".replace(
        "label AS query_id", "c.label AS query_id")


def _knn(spark, sf_dir, metric: str):
    """Ten nearest vectors of every class centre."""
    vectors = table(spark, sf_dir, "embeddings")
    means = class_mean(vectors, "label", "embedding").withColumn("mean", F.round("mean", 6))
    centres = means.groupBy(F.col("label").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("m")).select("query_id", F.col("m")["mean"].alias("q"))
    found = search.knn_search(vectors, centres, 10, "vec_id", "embedding", "query_id", "q", metric)
    return found.withColumn("score", F.round("score", 6))


@query("knn_search", _knn_sql("list_distance(e.embedding::DOUBLE[], c.q)", "score"))
def knn_search(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


@query("knn_search_inner_product", _knn_sql("list_inner_product(e.embedding::DOUBLE[], c.q)", "score DESC"))
def knn_search_inner_product(spark, sf_dir):
    return _knn(spark, sf_dir, "inner_product")


@query("knn_search_every_vector", """SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 7 > 0 AND b.vec_id % 7 > 0)) WHERE rank <= 3""")
def knn_search_every_vector(spark, sf_dir):
    """Every vector as a query; a seventh of them has a NaN."""
    broken = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda v, i: F.when(i == 5, float("nan")).otherwise(v).cast("float")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(broken, F.col("embedding")).alias("embedding"))
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = search.knn_search(vectors, asked, 3, "vec_id", "embedding", "query_id", "q")
    return found.withColumn("score", F.round("score", 6))


_TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


_TEXT_SEARCH = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TOKENS.format('text')} AS toks FROM documents),
  z AS (SELECT count(*) AS n, avg(len(toks)) AS m FROM d),
  q AS (SELECT DISTINCT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
  t AS MATERIALIZED (SELECT doc_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d)
     WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
  s AS (SELECT item_id, doc_id, round(sum(ln(1 + (z.n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / z.m))), 6) AS score
     FROM q JOIN f USING (term) JOIN t USING (term), z GROUP BY item_id, doc_id)
  SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


@query("text_search", _TEXT_SEARCH)
def text_search(spark, sf_dir):
    """Whole benchmark items as queries over whole documents."""
    return search.text_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "wanted"),
                              10, "doc_id", "text", "item_id", "wanted")


@query("text_index_search", _TEXT_SEARCH)
def text_index_search(spark, sf_dir):
    """The same search through a written index."""
    path = scratch_path(spark, "text-index")
    text_index.write_text_index(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    return text_index.search_text_index(spark, path, table(spark, sf_dir, "benchmark"), 10, "item_id", "text", "doc_id")
