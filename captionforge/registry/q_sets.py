"""Appending and interleaving, with documents split into datasets by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.operators import combine as K, splits
from captionforge.registry import query, sqltext as S, table


@query("concat_rows", """SELECT 0 AS source_no, p_partkey AS id, p_name AS name, p_size AS size FROM part
  UNION ALL BY NAME SELECT 1 AS source_no, c_custkey AS id, c_name AS name FROM customer
  UNION ALL BY NAME SELECT 2 AS source_no, s_suppkey AS id, s_name AS name FROM supplier""")
def concat_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return K.concat_rows([part, customer, supplier])


@query("add_item", "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT -1, 1, NULL")
def add_item(spark, sf_dir):
    return K.add_item(table(spark, sf_dir, "labels"), {"doc_id": -1, "quality": 1})


_SOURCES = ["de", "en", "es", "fr"]
_ROWS = "SELECT doc_id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS ds FROM documents"
_PLACED = f"""p AS (SELECT doc_id, ds, row_number() OVER (PARTITION BY ds ORDER BY doc_id) - 1 AS k FROM ({_ROWS})),
  l AS (SELECT ds, count(*) AS n FROM p GROUP BY ds)"""


def _rows(spark, sf_dir):
    numbers = F.array(*map(F.lit, _SOURCES))
    return table(spark, sf_dir, "documents").select(
        "doc_id", (F.array_position(numbers, F.col("lang")) - 1).cast("int").alias("ds"))


@query("interleave_cycle", f"WITH {_PLACED} SELECT doc_id, ds, k * 4 + ds AS out_idx FROM p WHERE k < (SELECT min(n) FROM l)")
def interleave_cycle(spark, sf_dir):
    return K.interleave_cycle(_rows(spark, sf_dir), "ds", ["doc_id"])


@query("interleave_cycle_all", f"""WITH {_PLACED} SELECT doc_id, p.ds, s.i * 4 + p.ds AS out_idx FROM range((SELECT max(n) FROM l)) s(i)
  JOIN l ON true JOIN p ON p.ds = l.ds AND p.k = s.i % l.n""")
def interleave_cycle_all(spark, sf_dir):
    return K.interleave_cycle_all(_rows(spark, sf_dir), "ds", ["doc_id"])


_P = {0: 0.25, 1: 0.5, 2: 0.125, 3: 0.125}


def _prob_sql(seed: int, stop: str) -> str:
    u = S.uniform(seed, "i")
    return f"""WITH {_PLACED}, d AS MATERIALIZED (SELECT i AS step, CASE WHEN {u} < 0.25 THEN 0 WHEN {u} < 0.75 THEN 1 WHEN {u} < 0.875 THEN 2 ELSE 3 END AS ds
    FROM range((SELECT count(*) * 12 + 2000 FROM documents)) g(i)),
  o AS (SELECT step, ds, row_number() OVER (PARTITION BY ds ORDER BY step) - 1 AS occ FROM d),
  e AS (SELECT {stop}(step) AS last FROM o JOIN l USING (ds) WHERE occ = n - 1)
  SELECT p.doc_id, p.ds, o.step AS out_idx FROM o JOIN l ON o.ds = l.ds JOIN p ON p.ds = o.ds AND p.k = o.occ % l.n WHERE o.step <= (SELECT last FROM e)"""


@query("interleave_prob", _prob_sql(31, "min"))
def interleave_prob(spark, sf_dir):
    return K.interleave_prob(_rows(spark, sf_dir), "ds", ["doc_id"], _P, 31)


@query("interleave_prob_all", _prob_sql(37, "max"))
def interleave_prob_all(spark, sf_dir):
    return K.interleave_prob(_rows(spark, sf_dir), "ds", ["doc_id"], _P, 37, all_exhausted=True)


_SPLIT = f"(SELECT doc_id, lang, CASE WHEN {S.uniform(2, 'doc_id')} < 0.3 THEN 'test' ELSE 'train' END AS split FROM documents)"


def _split(spark, sf_dir):
    split = F.when(hash_uniform(2, F.col("doc_id")) < 0.3, "test").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", split.alias("split"))


@query("per_split", f"SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS split_idx FROM {_SPLIT}")
def per_split(spark, sf_dir):
    return splits.index_per_split(_split(spark, sf_dir), ["doc_id"], "split_idx").select("split", "doc_id", "split_idx")


@query("per_split_shuffle", f"SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY {S.uniform(6, 'doc_id')}, doc_id) - 1 AS shuffled_idx FROM {_SPLIT}")
def per_split_shuffle(spark, sf_dir):
    return splits.shuffle_per_split(_split(spark, sf_dir), ["doc_id"], 6).select("split", "doc_id", "shuffled_idx")


@query("per_split_shards", f"""SELECT split, doc_id, CAST(CASE WHEN i < m * (d + 1) THEN i // (d + 1) ELSE m + (i - m * (d + 1)) // greatest(d, 1) END AS BIGINT) AS shard
  FROM (SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY split) // 3 AS d,
  count(*) OVER (PARTITION BY split) % 3 AS m FROM {_SPLIT})""")
def per_split_shards(spark, sf_dir):
    return splits.shard_per_split(_split(spark, sf_dir), ["doc_id"], 3).select("split", "doc_id", "shard")


@query("per_split_unique", f"SELECT split, lang, min(doc_id) AS first_seen FROM {_SPLIT} GROUP BY split, lang")
def per_split_unique(spark, sf_dir):
    return splits.unique_per_split(_split(spark, sf_dir), "lang", "doc_id")
