"""Array functions over the embeddings table, one output row per vector element."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.functions import vectors as V
from captionforge.functions.rand import hash_uniform
from captionforge.registry import query, sqltext as S, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_LONG = "SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)"


def _exploded(df, *columns: str, digits: int = 6):
    """posexplode arrays of equal length side by side."""
    rows = df.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("i", "z"))
    return rows.select("vec_id", "i", *[(F.round(f"z.{c}", digits) + F.lit(0.0)).alias(c) for c in columns])


@query("scale_unit", f"SELECT vec_id, i, round(2.0::DOUBLE * x - 1.0::DOUBLE, 6) + 0.0::DOUBLE AS y FROM ({_LONG})")
def scale_unit(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir).withColumn("y", V.scale_unit(F.col("v"))), "y")


@query("scale_signed", f"""SELECT vec_id, i, round((x * 255 - 127.5::DOUBLE) / 127.5::DOUBLE, 6) + 0.0::DOUBLE AS y, round(x * 255, 6) + 0.0::DOUBLE AS back,
  greatest(0, least(255, CAST(trunc((x * 4 + 1.0::DOUBLE) / 2.0::DOUBLE * 255.0::DOUBLE) AS INTEGER)))::DOUBLE AS pixel FROM ({_LONG})""")
def scale_signed(spark, sf_dir):
    scaled = V.scale_signed(F.transform("v", lambda x: x * 255))
    rows = _vectors(spark, sf_dir).withColumn("y", scaled).withColumn("back", V.unscale_signed(F.col("y")))
    rows = rows.withColumn("pixel", F.transform(V.to_pixels(F.transform("v", lambda x: x * 4)), lambda p: p.cast("double")))
    return _exploded(rows, "y", "back", "pixel")


_TOKENS = "SELECT conv_id, turn, string_split(text, ' ') AS toks FROM conversations"


def _padded(spark, sf_dir, side):
    toks = F.transform(F.split("text", " "), lambda t: F.length(t))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", toks.alias("toks"))
    rows = rows.select("conv_id", "turn", F.arrays_zip(
        V.pad_truncate(F.col("toks"), 77, F.lit(-1), side).alias("token"),
        V.attention_mask(F.col("toks"), 77, side).alias("mask")).alias("z"))
    rows = rows.select("conv_id", "turn", F.posexplode("z").alias("i", "e"))
    return rows.select("conv_id", "turn", "i", "e.token", "e.mask")


def _pad_sql(at: str) -> str:
    return f"""SELECT conv_id, turn, CAST(i AS INTEGER) AS i, CASE WHEN {at} BETWEEN 1 AND least(len(toks), 77) THEN CAST(length(toks[{at}]) AS INTEGER) ELSE -1 END AS token,
  CASE WHEN {at} BETWEEN 1 AND least(len(toks), 77) THEN 1 ELSE 0 END AS mask FROM ({_TOKENS}), range(77) r(i)"""


@query("pad_truncate", _pad_sql("(i + 1)"))
def pad_truncate(spark, sf_dir):
    return _padded(spark, sf_dir, "right")


@query("pad_left", _pad_sql("(i + 1 - (77 - least(len(toks), 77)))"))
def pad_left(spark, sf_dir):
    return _padded(spark, sf_dir, "left")


@query("masked_states", f"SELECT vec_id, i, round(CASE WHEN i < label * 7 THEN x ELSE 0 END, 6) + 0.0::DOUBLE AS y FROM ({_LONG})")
def masked_states(spark, sf_dir):
    mask = F.transform("v", lambda _, i: F.when(i < F.col("label") * 7, 1).otherwise(0))
    return _exploded(_vectors(spark, sf_dir).withColumn("y", V.apply_mask(F.col("v"), mask)), "y")


@query("pad_concat", """SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN i < 64 THEN embedding[i + 1]::DOUBLE WHEN i < 64 + label * 5 THEN embedding[i - 63]::DOUBLE ELSE 0 END, 6) + 0.0::DOUBLE AS y
  FROM embeddings, range(128) r(i)""")
def pad_concat(spark, sf_dir):
    narrow = F.slice("v", F.lit(1), F.col("label") * 5)
    return _exploded(_vectors(spark, sf_dir).withColumn("y", V.pad_concat(F.col("v"), narrow)), "y")


@query("pad_sentinel", "SELECT vec_id, CAST(80 - least(label * 9, 64) AS INTEGER) AS n_pad, CAST(least(label * 9, 64) AS INTEGER) AS n_real, round(list_sum(embedding[1:label * 9]::DOUBLE[]), 6) AS total FROM embeddings")
def pad_sentinel(spark, sf_dir):
    cut = F.slice("v", F.lit(1), F.col("label") * 9)
    rows = _vectors(spark, sf_dir).select("vec_id", V.pad_sentinel(cut, 80).alias("p"))
    real = V.drop_sentinel(F.col("p"))
    total = F.aggregate(real, F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", (F.size("p") - F.size(real)).alias("n_pad"), F.size(real).alias("n_real"),
                       F.round(F.when(F.size(real) > 0, total), 6).alias("total"))


def _drop(name: str, p: float) -> str:
    return f"{S.uniform(13, 'vec_id', S.quote(name))} < {p}"


@query("cond_dropout", f"""SELECT vec_id, i, round(CASE WHEN {_drop('pooled', 0.1)} THEN 0 ELSE x END, 6) + 0.0::DOUBLE AS pooled,
  round(CASE WHEN (CASE WHEN i < 32 THEN {_drop('first', 0.316)} ELSE {_drop('second', 0.316)} END) THEN 0 ELSE x END, 6) + 0.0::DOUBLE AS states FROM ({_LONG})""")
def cond_dropout(spark, sf_dir):
    flags = V.cond_dropout_flags(13, F.col("vec_id"))
    rows = _vectors(spark, sf_dir).withColumns(flags)
    rows = rows.withColumns({
        "pooled": V.drop_vector(F.col("v"), F.col("drop_pooled")),
        "states": V.drop_steps(F.col("v"), F.col("drop_first"), F.col("drop_second"), steps=32),
    })
    return _exploded(rows, "pooled", "states")


@query("token_mask", f"""SELECT vec_id, i, ({S.uniform(41, 'vec_id', 'i')} < 0.25) AND (CASE WHEN i < 32 THEN {_drop('first', 0.316)} ELSE {_drop('second', 0.316)} END) AS masked FROM ({_LONG})""")
def token_mask(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumns(V.cond_dropout_flags(13, F.col("vec_id")))
    mask = V.token_mask(F.col("v"), F.col("drop_first"), F.col("drop_second"), 41, F.col("vec_id"), steps=32)
    return rows.select("vec_id", F.posexplode(mask).alias("i", "masked"))


_EPS = S.normal(17, "vec_id", "i")
_T = S.uniform(43, "vec_id")


@query("noise_mix", f"""SELECT vec_id, i, round((1.0 - t) * x + t * e, 6) + 0.0::DOUBLE AS noised, round(e - x, 6) + 0.0::DOUBLE AS target
  FROM (SELECT vec_id, i, x, {_EPS} AS e, {_T} AS t FROM ({_LONG}))""")
def noise_mix(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("e", V.noise_like(F.col("v"), 17, F.col("vec_id")))
    t = hash_uniform(43, F.col("vec_id"))
    rows = rows.withColumn("t", t).withColumn("noised", V.noise_mix(F.col("v"), F.col("e"), F.col("t")))
    return _exploded(rows.withColumn("target", V.velocity(F.col("v"), F.col("e"))), "noised", "target")


@query("masked_mse", f"""SELECT label, round(avg(loss), 9) AS loss, round(avg(masked), 9) AS masked FROM
  (SELECT vec_id, label, avg((x - x * x) ** 2) AS loss, avg(CASE WHEN i < 32 THEN (x - x * x) ** 2 ELSE 0 END) AS masked FROM ({_LONG}) GROUP BY vec_id, label) GROUP BY label""")
def masked_mse(spark, sf_dir):
    v = F.col("v")
    squared = F.transform(v, lambda x: x * x)
    mask = F.transform(v, lambda _, i: i < 32)
    rows = _vectors(spark, sf_dir).select(
        "label", V.masked_mse(v, squared).alias("loss"), V.masked_mse(v, squared, mask).alias("masked"))
    return rows.groupBy("label").agg(F.round(F.avg("loss"), 9).alias("loss"), F.round(F.avg("masked"), 9).alias("masked"))
