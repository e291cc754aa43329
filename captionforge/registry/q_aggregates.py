"""Feature statistics, Frechet distance, metric series, distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.functions import vectors as V
from captionforge.operators import stats as A
from captionforge.plans import evaluation
from captionforge.registry import query, sqltext as S, table


@query("unique", "SELECT source, lang, min(doc_id) AS first_seen FROM documents GROUP BY source, lang")
def unique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", "lang").alias("both"))
    return A.unique(docs, "both", "doc_id").select("both.source", "both.lang", "first_seen")


_LONG = "SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)"


@query("class_mean", f"SELECT label, CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(x), 6) AS mean FROM ({_LONG}) GROUP BY label, i")
def class_mean(spark, sf_dir):
    return A.class_mean(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("class_cov", f"""WITH v AS MATERIALIZED ({_LONG}) SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) + 0.0::DOUBLE AS cov
  FROM v a JOIN v b USING (vec_id) GROUP BY a.label, a.i, b.i""")
def class_cov(spark, sf_dir):
    stats = A.class_stats(table(spark, sf_dir, "embeddings"), "label", "embedding", ["vec_id"])
    # adding 0.0 turns a rounded -0.0 into 0.0
    return A.class_cov(stats, "label").withColumn("cov", F.round("cov", 6) + F.lit(0.0))


@query("frechet_distance")
def frechet_distance(spark, sf_dir):
    """Real vectors against the same vectors with a little seeded noise mixed in."""
    real = table(spark, sf_dir, "embeddings")
    noised = V.noise_mix(F.col("embedding"), V.noise_like(F.col("embedding"), 17, F.col("vec_id")), F.lit(0.1))
    distance = evaluation.frechet_per_class(real, real.withColumn("embedding", noised), "label", "embedding", ["vec_id"])
    return distance.withColumn("distance", F.round("distance", 3))


@query("frechet_distance_affine", f"""WITH m AS (SELECT label, i, avg(x) AS mu, var_samp(x) AS var FROM ({_LONG}) GROUP BY label, i)
  SELECT label, round(sum((mu - (0.5 * mu + 0.1)) ** 2) + 0.25 * sum(var), 4) AS distance FROM m GROUP BY label""")
def frechet_distance_affine(spark, sf_dir):
    """Against 0.5 x + 0.1, where the distance has a closed form: sqrt(S * 0.25 S) = 0.5 S."""
    real = table(spark, sf_dir, "embeddings")
    moved = real.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 0.5 + 0.1))
    distance = evaluation.frechet_per_class(real, moved, "label", "embedding", ["vec_id"])
    return distance.withColumn("distance", F.round("distance", 4))


_STEPS = "SELECT event_type, event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS step FROM events"


@query("step_mean", f"SELECT step // 50 AS log_window, count(*) AS n, round(avg(value), 6) AS mean_value FROM ({_STEPS}) GROUP BY step // 50")
def step_mean(spark, sf_dir):
    # event ids are dense from 0: they are the micro-step numbers
    means = A.step_mean(table(spark, sf_dir, "events"), "event_id", "value", log_steps=25, accumulation=2)
    return means.withColumn("mean_value", F.round("mean_value", 6))


def _ema_sql(decay: float, every: int) -> str:
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT event_type, p // {every} AS pos, value FROM
    (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p FROM events) WHERE p % {every} = 0),
  r AS (SELECT event_type, pos, value AS ema FROM s WHERE pos = 0 UNION ALL
    SELECT s.event_type, s.pos, {decay}::DOUBLE * r.ema + (1.0::DOUBLE - {decay}::DOUBLE) * s.value FROM r JOIN s ON s.event_type = r.event_type AND s.pos = r.pos + 1)
  SELECT event_type, pos, round(ema, 6) AS ema FROM r"""


@query("ema_series", _ema_sql(0.9, 1))
def ema_series(spark, sf_dir):
    series = A.ema_series(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], "value", 0.9)
    return series.withColumn("ema", F.round("ema", 6))


@query("ema_series_every", _ema_sql(0.99, 4))
def ema_series_every(spark, sf_dir):
    series = A.ema_series(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], "value", 0.99, every=4, width=16)
    return series.withColumn("ema", F.round("ema", 6))
