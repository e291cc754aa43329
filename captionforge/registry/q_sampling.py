"""Buckets and the seeded batch plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.functions import captions as C, vectors as V
from captionforge.operators import buckets as B
from captionforge.plans import feed
from captionforge.registry import query, sqltext as S, table
from captionforge.registry.inputs import BUCKETED, CAPTIONED, bucketed, captioned

BATCH = 16
_STATS = f"SELECT bucket_size, count(*) AS n FROM ({BUCKETED}) GROUP BY bucket_size"


def _stats(spark, sf_dir):
    return bucketed(spark, sf_dir).groupBy("bucket_size").agg(F.count(F.lit(1)).alias("n"))


@query("bucket_index", f"SELECT bucket_size, row_idx, row_number() OVER (PARTITION BY bucket_size ORDER BY row_idx) - 1 AS bucket_pos FROM ({BUCKETED})")
def bucket_index(spark, sf_dir):
    return B.bucket_index(bucketed(spark, sf_dir))


@query("bucket_stats", f"SELECT bucket_size, n, round(n / sum(n) OVER (), 9) AS share FROM ({_STATS})")
def bucket_stats(spark, sf_dir):
    return B.bucket_stats(bucketed(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("bucket_prune", "SELECT o_custkey AS bucket_size, count(*) AS n, count(*) > 12 AS kept, count(*) <= 4 AS reported FROM orders GROUP BY o_custkey")
def bucket_prune(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("bucket_size")).agg(F.count(F.lit(1)).alias("n"))
    return B.bucket_prune(counts, 4)


_MAX = f"SELECT max(CAST(split_part(bucket_size, 'x', 1) AS INTEGER)) AS first_side, max(CAST(split_part(bucket_size, 'x', 2) AS INTEGER)) AS second_side FROM ({_STATS})"


@query("bucket_max_shape", f"""SELECT first_side, second_side, first_side || 'x' || second_side AS max_shape, s.bucket_size AS existing
  FROM ({_MAX}) LEFT JOIN ({_STATS}) s ON s.bucket_size = first_side || 'x' || second_side""")
def bucket_max_shape(spark, sf_dir):
    return B.bucket_max_shape(_stats(spark, sf_dir))


@query("bucket_epoch_len", f"SELECT CAST(sum(n // {BATCH}) AS BIGINT) AS n_batches FROM ({_STATS})")
def bucket_epoch_len(spark, sf_dir):
    return B.bucket_epoch_len(_stats(spark, sf_dir), BATCH)


@query("class_index", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bucket_pos FROM embeddings")
def class_index(spark, sf_dir):
    return B.class_index(table(spark, sf_dir, "embeddings"), "vec_id", "label")




def batches_sql(seed: int, first_n: int = 0) -> str:
    forced = f"CASE WHEN batch_id < {first_n} THEN (SELECT first_side || 'x' || second_side FROM ({_MAX})) ELSE drawn END"
    drawn = f"CAST(trunc({S.uniform(seed, S.quote('place'), 'batch_id', 'j')} * (n - {BATCH} + j + 1)) AS BIGINT)"
    return f"""WITH rows AS ({BUCKETED}), stats AS (SELECT bucket_size, n FROM ({_STATS}) WHERE n > {3 * BATCH}),
 edges AS (SELECT bucket_size, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM stats),
 d AS (SELECT i AS batch_id, CAST(trunc({S.uniform(seed, S.quote('bucket'), 'i')} * (SELECT sum(n) FROM stats)) AS BIGINT) AS r
   FROM range((SELECT CAST(sum(n // {BATCH}) AS BIGINT) FROM stats)) g(i)),
 p AS (SELECT batch_id, {forced} AS bucket_size FROM (SELECT batch_id, bucket_size AS drawn FROM d JOIN edges ON r >= lo AND r < lo + n)),
 s AS (SELECT batch_id, p.bucket_size, list_reduce(list_concat([[]::BIGINT[]], list_transform(range({BATCH}), lambda j: [{drawn}, n - {BATCH} + j])),
   lambda have, d: list_append(have, CASE WHEN list_contains(have, d[1]) THEN d[2] ELSE d[1] END)) AS picked FROM p JOIN stats USING (bucket_size)),
 k AS (SELECT batch_id, bucket_size, CAST(j AS INTEGER) AS pos_in_batch, picked[j + 1] AS bucket_pos FROM s, range({BATCH}) h(j)),
 x AS (SELECT bucket_size, row_idx, row_number() OVER (PARTITION BY bucket_size ORDER BY row_idx) - 1 AS bucket_pos FROM rows)
SELECT batch_id, bucket_size, pos_in_batch, row_idx FROM k JOIN x USING (bucket_size, bucket_pos)"""


@query("bucket_batches", batches_sql(19))
def bucket_batches(spark, sf_dir):
    return B.bucket_batches(bucketed(spark, sf_dir), BATCH, 19)


@query("first_n_largest", batches_sql(23, first_n=3))
def first_n_largest(spark, sf_dir):
    return B.bucket_batches(bucketed(spark, sf_dir), BATCH, 23, first_n=3)


@query("batch_caption_choice", f"SELECT doc_id, {S.trim(f'CASE WHEN {S.uniform(8, 'doc_id // 16')} < 0.5 THEN recaption ELSE recaption_short END')} AS caption FROM ({CAPTIONED})")
def batch_caption_choice(spark, sf_dir):
    return captioned(spark, sf_dir).select("doc_id", C.batch_caption(
        F.col("recaption"), F.col("recaption_short"), 8, F.floor(F.col("doc_id") / 16)).alias("caption"))


@query("batch_pad_shape", f"""SELECT doc_id // 16 AS batch_id, max(h) AS max_h, max(w) AS max_w,
  round(1 - sum(h::BIGINT * w) / (count(*) * max(h)::BIGINT * max(w)), 9) AS padding FROM ({S.dims()}) GROUP BY doc_id // 16""")
def batch_pad_shape(spark, sf_dir):
    rows = captioned(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / 16))
    return feed.batch_pad_shape(rows, "batch_id", "h", "w").withColumn("padding", F.round("padding", 9))


@query("time_sample", f"SELECT o_orderkey, round(1.0 / (1.0 + exp(-({S.normal(4, 'o_orderkey')} * 1.0 + 0.0))), 9) AS t, round({S.uniform(4, 'o_orderkey')}, 9) AS t_uniform FROM orders")
def time_sample(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(V.time_sample(4, key), 9).alias("t"),
        F.round(V.time_sample(4, key, weighted=False), 9).alias("t_uniform"))


@query("lognorm_weight", f"""SELECT o_orderkey, round(t / (1 - t) * exp(-(ln(t / (1 - t)) ** 2) / 2) / sqrt(2 * pi()) / (t * (1 - t)), 6) AS weight
  FROM (SELECT o_orderkey, 0.001 + 0.998 * {S.uniform(6, 'o_orderkey')} AS t FROM orders)""")
def lognorm_weight(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (0.001 + 0.998 * V.time_sample(6, F.col("o_orderkey"), weighted=False)).alias("t"))
    return rows.select("o_orderkey", F.round(V.lognorm_weight(F.col("t")), 6).alias("weight"))


@query("training_feed", f"""WITH b AS ({batches_sql(29)})
  SELECT batch_id, pos_in_batch, b.row_idx, {S.uniform(29, S.quote('caption'), 'batch_id')} < 0.5 AS long_caption,
  {S.uniform(29, S.quote('drop'), 'batch_id', 'pos_in_batch', S.quote('pooled'))} < 0.1 AS drop_pooled,
  {S.uniform(29, S.quote('drop'), 'batch_id', 'pos_in_batch', S.quote('first'))} < 0.316 AS drop_first,
  {S.uniform(29, S.quote('drop'), 'batch_id', 'pos_in_batch', S.quote('second'))} < 0.316 AS drop_second,
  round(1.0 / (1.0 + exp(-({S.normal(29, S.quote('time'), 'batch_id', 'pos_in_batch')}))), 9) AS t, o_totalprice AS payload
  FROM b JOIN orders ON b.row_idx = o_orderkey""")
def training_feed(spark, sf_dir):
    rows = bucketed(spark, sf_dir)
    payload = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("payload"))
    planned = feed.training_feed(rows, payload, BATCH, 29)
    return planned.withColumn("t", F.round("t", 9)).drop("bucket_size")
