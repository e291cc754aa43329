"""Operator inputs derived from the driver tables, with the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.functions.captions import OPENINGS
from captionforge.registry import table
from captionforge.registry.sqltext import FIRST_SIDE, SECOND_SIDE, quote

# The generated prose has no stock openings or reject phrases, so each document gets one opening,
# and between 0 and 7 reject phrases, chosen by its id.
def _opening(number, upper: bool = False):
    texts = [o[:1].upper() + o[1:] if upper else o for o, _ in OPENINGS]
    return F.get(F.array(*map(F.lit, texts)), (number % len(texts)).cast("int"))


_LOWER_SQL = "[" + ", ".join(quote(o) for o, _ in OPENINGS) + "]"
_UPPER_SQL = "[" + ", ".join(quote(o[:1].upper() + o[1:]) for o, _ in OPENINGS) + "]"


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as caption rows: id, class, file, a long and a short caption, image sides."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("class"),
        F.col("source").alias("file"),
        F.concat(_opening(F.col("doc_id")), F.col("text")).alias("recaption"),
        F.concat(_opening(F.col("n_chars")), F.col("source"), F.lit(" "), F.col("n_chars")).alias("recaption_short"),
        F.expr("cast(1 + (doc_id * 37) % 2000 as int)").alias("h"),
        F.expr("cast(1 + n_chars % 2048 as int)").alias("w"),
    )


CAPTIONED = f"""SELECT doc_id, lang AS class, source AS file,
  list_extract({_LOWER_SQL}, doc_id % {len(OPENINGS)} + 1) || text AS recaption,
  list_extract({_LOWER_SQL}, n_chars % {len(OPENINGS)} + 1) || source || ' ' || n_chars AS recaption_short,
  {FIRST_SIDE} AS h, {SECOND_SIDE} AS w FROM documents"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as model output: two capitalised openings, the text, repeated reject phrases."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            _opening(F.col("doc_id"), upper=True), F.col("text"), F.lit(" "),
            _opening(F.col("doc_id") * 7 + 3, upper=True),
            F.repeat(F.lit(" no text other objects"), (F.col("doc_id") % 5).cast("int")), F.lit("  "),
        ).alias("caption"),
        F.col("source").alias("file"),
    )


GENERATED = f"""SELECT doc_id, list_extract({_UPPER_SQL}, doc_id % {len(OPENINGS)} + 1) || text || ' ' ||
  list_extract({_UPPER_SQL}, (doc_id * 7 + 3) % {len(OPENINGS)} + 1) ||
  repeat(' no text other objects', CAST(doc_id % 5 AS INTEGER)) || chr(160) || ' ' AS caption,
  source AS file FROM documents"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dataset rows in fifteen shape buckets (five first sides, three second sides)."""
    first = 256 + 128 * F.substring("o_orderpriority", 1, 1).cast("int")
    second = 256 + 128 * F.instr(F.lit("FOP"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        F.concat_ws("x", first.cast("string"), second.cast("string")).alias("bucket_size"),
    )


BUCKETED = """SELECT o_orderkey AS row_idx, CAST(256 + 128 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS VARCHAR)
  || 'x' || CAST(256 + 128 * instr('FOP', o_orderstatus) AS VARCHAR) AS bucket_size FROM orders"""


def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as one row each, with an array of the two turns the caption lookup reads.

    Two conditional maxima, so a conversation of any length is pre-aggregated to one row per task.
    """
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.struct(F.col("role").alias("from"), F.col("text").alias("value"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array(turn(0), turn(1)).alias("conversations"))
