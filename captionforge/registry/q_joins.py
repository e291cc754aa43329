"""Lookups, anti joins and side-by-side concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.operators import lookups as L
from captionforge.registry import query, sqltext as S, table
from captionforge.registry.inputs import first_turns

# conversations become one row per conv_id with its turns; documents are the caption side table:
# the key is the doc_id with its last digit dropped, so keys repeat and the last document wins.


def _talks(spark, sf_dir):
    return first_turns(spark, sf_dir).withColumnRenamed("conv_id", "id")


def _captions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 10).cast("string").alias("key"), "doc_id",
        F.when(F.col("lang") != "de", F.col("text")).alias("caption_llava"),
        F.when(F.col("lang") != "fr", F.concat_ws(" ", "source", "lang")).alias("caption_llava_short"))


_TALKS = "SELECT conv_id AS id, max(CASE WHEN turn = 1 THEN text END) AS second FROM conversations GROUP BY conv_id"
_SIDE = """SELECT key, caption_llava, caption_llava_short FROM (SELECT CAST(doc_id // 10 AS VARCHAR) AS key,
  CASE WHEN lang <> 'de' THEN text END AS caption_llava, CASE WHEN lang <> 'fr' THEN source || ' ' || lang END AS caption_llava_short,
  row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1"""


def _recaption_sql(main: str, short: str) -> str:
    long = S.trim(f"coalesce({main}, second)")
    return (f"SELECT id, {main} IS NULL AS missed, {long} AS recaption, {S.trim(f'coalesce({short}, {long})')} AS recaption_short, "
            f"'CC12M' AS class FROM ({_TALKS}) t LEFT JOIN ({_SIDE}) s ON CAST(t.id AS VARCHAR) = s.key")


@query("join_recaption", _recaption_sql("caption_llava_short", "caption_llava"))
def join_recaption(spark, sf_dir):
    return L.join_recaption(_talks(spark, sf_dir), _captions(spark, sf_dir), "doc_id")


@query("join_recaption_straight", _recaption_sql("caption_llava", "caption_llava_short"))
def join_recaption_straight(spark, sf_dir):
    return L.join_recaption(_talks(spark, sf_dir), _captions(spark, sf_dir), "doc_id", crossed=False)


@query("join_recaption_misses", "SELECT doc_id, lang FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def join_recaption_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    side = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    return L.join_recaption_misses(docs, side, "doc_id")


@query("join_class_name", """SELECT stem, n_name AS class FROM (SELECT n_nationkey || '_' || c_custkey AS stem, c_nationkey FROM customer
  JOIN nation ON c_nationkey = n_nationkey) JOIN nation ON c_nationkey = n_nationkey""")
def join_class_name(spark, sf_dir):
    images = table(spark, sf_dir, "customer").select(F.concat_ws("_", "c_nationkey", "c_custkey").alias("stem"))
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("wnid"), "n_name")
    return L.join_class_name(images, nations, "stem", "wnid", "n_name")


@query("skip_processed", "SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def skip_processed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return L.skip_processed(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("zip_columns", """SELECT a.o_orderkey, b.o_totalprice AS price, b.other FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) a
  JOIN (SELECT o_totalprice, o_orderkey AS other, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) b USING (i)""")
def zip_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    right = orders.select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("other"))
    return L.zip_columns(orders.select("o_orderkey"), ["o_orderkey"], right, ["price", "other"])


@query("add_column", """SELECT a.doc_id, a.lang, b.n_chars AS size FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS i FROM documents) a
  JOIN (SELECT n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents) b USING (i)""")
def add_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    values = docs.select(F.struct("n_chars", "doc_id").alias("place"), "n_chars")
    return L.add_column(docs.select("doc_id", "lang"), ["doc_id"], "size", values, ["place"])


@query("class_of_split_members", "SELECT vec_id, label FROM embeddings WHERE label IN (SELECT quality + 3 FROM labels)")
def class_of_split_members(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select((F.col("quality") + 3).alias("label"))
    return L.rows_of_class(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", wanted)
