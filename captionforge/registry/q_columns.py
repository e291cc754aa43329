"""Projection, casts, class encoding, filters, shape arithmetic, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions import captions as C
from captionforge.functions import images, shapes
from captionforge.operators import filters, schema
from captionforge.plans import training_set
from captionforge.registry import query, sqltext as S, table
from captionforge.registry.inputs import CAPTIONED, GENERATED, captioned, first_turns, generated


@query("select_columns", "SELECT doc_id, lang FROM documents")
def select_columns(spark, sf_dir):
    return schema.select_columns(table(spark, sf_dir, "documents"), ["doc_id", "lang"])


@query("remove_columns", "SELECT doc_id, lang, source FROM documents")
def remove_columns(spark, sf_dir):
    return schema.remove_columns(table(spark, sf_dir, "documents"), ["text", "n_chars"])


@query("rename_columns", "SELECT doc_id AS id, text AS recaption, lang AS class, source, n_chars FROM documents")
def rename_columns(spark, sf_dir):
    return schema.rename_columns(table(spark, sf_dir, "documents"),
                                 {"doc_id": "id", "text": "recaption", "lang": "class"})


@query("rename_column", "SELECT doc_id, quality AS score, toxic FROM labels")
def rename_column(spark, sf_dir):
    return schema.rename_columns(table(spark, sf_dir, "labels"), {"quality": "score"})


@query("cast", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels")
def cast(spark, sf_dir):
    target = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("quality", T.LongType()),
                           T.StructField("toxic", T.DoubleType())])
    return schema.cast(table(spark, sf_dir, "labels"), target)


@query("cast_column", "SELECT CAST(doc_id AS INTEGER) AS doc_id, quality, toxic FROM labels")
def cast_column(spark, sf_dir):
    return schema.cast_column(table(spark, sf_dir, "labels"), "doc_id", "int")


@query("flatten", """SELECT doc_id, lang AS "meta.lang", source AS "meta.origin.source", n_chars AS "meta.origin.n_chars" FROM documents""")
def flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct("lang", F.struct("source", "n_chars").alias("origin")).alias("meta"))
    return schema.flatten(nested)


@query("const_column", "SELECT doc_id, 'CC12M' AS class, '' AS recaption_short, CAST(999999999 AS INTEGER) AS id FROM documents")
def const_column(spark, sf_dir):
    docs = schema.select_columns(table(spark, sf_dir, "documents"), ["doc_id"])
    return schema.add_constants(docs, **{"class": "CC12M", "recaption_short": "", "id": 999999999})


@query("struct_field", """SELECT conv_id, max(CASE WHEN turn = 1 THEN text END) AS second_value,
  max(CASE WHEN turn = 0 THEN role END) AS first_role FROM conversations GROUP BY conv_id""")
def struct_field(spark, sf_dir):
    talks = first_turns(spark, sf_dir)
    return talks.select("conv_id", F.get("conversations", 1)["value"].alias("second_value"),
                        F.get("conversations", 0)["from"].alias("first_role"))


@query("class_encode", """SELECT doc_id, c.class_id AS lang FROM documents JOIN
  (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS class_id FROM (SELECT DISTINCT lang FROM documents)) c USING (lang)""")
def class_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return schema.class_encode(docs, "lang")[0]


@query("class_encode_nulls", """WITH v AS (SELECT doc_id, coalesce(CAST(CASE WHEN quality = 1 THEN toxic END AS VARCHAR), 'None') AS c FROM labels)
  SELECT doc_id, k.id AS flag FROM v JOIN (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT c FROM v)) k USING (c)""")
def class_encode_nulls(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("toxic")).alias("flag"))
    return schema.class_encode(flags, "flag", include_nulls=True)[0]


@query("align_labels", "SELECT vec_id, CAST(9 - label AS INTEGER) AS label FROM embeddings")
def align_labels(spark, sf_dir):
    names = [f"Class_{i}" for i in range(10)]
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    return schema.align_labels(vectors, "label", names, {f"CLASS_{i}": 9 - i for i in range(10)})


@query("label_rebase", "SELECT vec_id, CAST(label - 3 AS INTEGER) AS label FROM embeddings")
def label_rebase(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", schema.rebase_label(F.col("label"), 3).cast("int").alias("label"))


# ---- filters ----

@query("filter", "SELECT doc_id, lang FROM documents WHERE n_chars > 500 AND lang <> 'de'")
def filter_(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return filters.filter_rows(docs, (F.col("n_chars") > 500) & (F.col("lang") != "de")).select("doc_id", "lang")


@query("filter_with_index", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM documents)
  WHERE i >= (SELECT count(*) // 4 FROM documents)""")
def filter_with_index(spark, sf_dir):
    """All but the shortest quarter of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    cut = docs.count() // 4
    return filters.filter_with_index(docs, ["n_chars", "doc_id"], lambda i: i >= cut).select("doc_id", "lang")


@query("dropna_subset", f"""SELECT doc_id, class FROM (SELECT doc_id, class, CASE WHEN h > 512 THEN h END AS height, CASE WHEN w > 700 THEN w END AS width FROM ({CAPTIONED}))
  WHERE height IS NOT NULL AND width IS NOT NULL""")
def dropna_subset(spark, sf_dir):
    rows = captioned(spark, sf_dir).select("doc_id", "class", F.when(F.col("h") > 512, F.col("h")).alias("height"),
                                           F.when(F.col("w") > 700, F.col("w")).alias("width"))
    return filters.dropna_subset(rows, ["height", "width"]).select("doc_id", "class")


@query("filter_lowres", f"SELECT doc_id, h, w FROM ({S.dims()}) WHERE h >= 256 OR w >= 256")
def filter_lowres(spark, sf_dir):
    return captioned(spark, sf_dir).where(shapes.is_high_resolution(F.col("h"), F.col("w"))).select("doc_id", "h", "w")


_CLEAN = "SELECT *, {} AS long, {} AS short FROM ({})".format(
    S.capitalize(S.strip_all("recaption")), S.capitalize(S.strip_all("recaption_short")), CAPTIONED)


def _cleaned(spark, sf_dir):
    return training_set.clean_captions(captioned(spark, sf_dir), ["recaption", "recaption_short"])


@query("filter_short_caption", f"SELECT doc_id, long AS recaption, short AS recaption_short FROM ({_CLEAN}) WHERE length(long) >= 10 AND length(short) >= 10")
def filter_short_caption(spark, sf_dir):
    rows = training_set.clean_and_keep(captioned(spark, sf_dir), ["recaption", "recaption_short"])
    return rows.select("doc_id", "recaption", "recaption_short")


@query("filter_status", "SELECT event_id, status FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed_to_download' ELSE 'success' END AS status FROM events) WHERE status = 'success'")
def filter_status(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed_to_download").otherwise("success")
    return filters.filter_status(table(spark, sf_dir, "events").select("event_id", status.alias("status")))


@query("filter_empty_file", f"SELECT file, count(*) AS n_rows FROM ({GENERATED}) WHERE NOT ({S.repeats('caption')} > 5) GROUP BY file HAVING count(*) >= 10")
def filter_empty_file(spark, sf_dir):
    good = generated(spark, sf_dir).where(C.caption_repeats(F.col("caption")) <= C.MAX_REJECT_PHRASES)
    return filters.surviving_files(good, "file", 10)


_KEPT = "(h >= 256 OR w >= 256) AND length(long) >= 10 AND length(short) >= 10"


@query("quality_report", f"""SELECT file, count(*) AS n_in, count(*) FILTER ({_KEPT}) AS n_kept, count(*) FILTER (NOT ({_KEPT})) AS n_dropped,
  round(100.0::DOUBLE * count(*) FILTER (NOT ({_KEPT})) / count(*), 6) AS pct_dropped FROM ({_CLEAN}) GROUP BY GROUPING SETS ((file), ())""")
def quality_report(spark, sf_dir):
    kept = shapes.is_high_resolution(F.col("h"), F.col("w")) & filters.long_enough(
        F.col("recaption"), F.col("recaption_short"))
    report = filters.quality_report(_cleaned(spark, sf_dir), "file", kept)
    return report.withColumn("pct_dropped", F.round("pct_dropped", 6))


# ---- shapes ----

@query("image_probe", f"SELECT doc_id, w AS width, h AS height, w AS stored_height, round(h / w, 6) AS aspect_ratio FROM ({S.dims()})")
def image_probe(spark, sf_dir):
    side = lambda c: F.lpad(F.hex(F.col(c)), 8, "0")
    header = F.unhex(F.concat(F.lit(shapes.PNG_SIGNATURE + "0000000D49484452"), side("w"), side("h")))
    probed = captioned(spark, sf_dir).select("doc_id", shapes.png_size(header).alias("size"))
    compat = shapes.compat_probe(F.col("size"))
    return probed.select("doc_id", "size.width", "size.height", compat["height"].alias("stored_height"),
                         F.round(compat["aspect_ratio"], 6).alias("aspect_ratio"))


@query("image_probe_headers", f"SELECT doc_id, w AS width, h AS height FROM ({S.dims()})")
def image_probe_headers(spark, sf_dir):
    """GIF headers for wide images, JPEG headers for the others."""
    big = lambda c: F.lpad(F.hex(F.col(c)), 4, "0")
    little = lambda c: F.concat(F.substring(big(c), 3, 2), F.substring(big(c), 1, 2))
    gif = F.concat(F.hex(F.lit("GIF89a")), little("w"), little("h"))
    jpeg = F.concat(F.lit("FFD8FFE000044A46FFC0000B08"), big("h"), big("w"))
    body = F.unhex(F.when(F.col("w") > F.col("h"), gif).otherwise(jpeg))
    sized = captioned(spark, sf_dir).select("doc_id", body.alias("image")).select("doc_id", images.image_size(F.col("image")).alias("s"))
    return sized.select("doc_id", "s.width", "s.height")


@query("image_probe_formats", f"""SELECT doc_id, doc_id % 7 AS kind, CASE WHEN doc_id % 7 < 6 THEN w END AS width, CASE WHEN doc_id % 7 < 6 THEN h END AS height
  FROM ({S.dims()})""")
def image_probe_formats(spark, sf_dir):
    """WebP (three kinds), BMP, TIFF, JPEG with fill bytes, and bytes that are no image."""
    big = lambda c, n=4: F.lpad(F.hex(c), n, "0")
    little = lambda c, n=4: F.concat(*[F.substring(big(c, n), i, 2) for i in range(n - 1, 0, -2)])
    w, h, riff = F.col("w"), F.col("h"), F.concat(F.hex(F.lit("RIFF")), F.lit("00000000"), F.hex(F.lit("WEBP")))
    bits = (w - 1).cast("long") + (h - 1).cast("long") * 16384
    bodies = [
        F.concat(riff, F.hex(F.lit("VP8X")), F.lit("0A00000000000000"), little(w - 1, 6), little(h - 1, 6)),
        F.concat(riff, F.hex(F.lit("VP8 ")), F.lit("000000000000009D012A"), little(w), little(h)),
        F.concat(riff, F.hex(F.lit("VP8L")), F.lit("000000002F"), little(bits, 8)),
        F.concat(F.hex(F.lit("BM")), F.lit("00" * 12 + "28000000"), little(w, 8), little(h, 8)),
        F.concat(F.lit("4D4D002A000000080002" + "0100000300000001"), big(w), F.lit("0000" + "0101000400000001"), big(h, 8)),
        F.concat(F.lit("FFD8FFFFFFE000044A46FFFFC0000B08"), big(h), big(w)),
        F.lit("00112233"),
    ]
    kind = F.col("doc_id") % 7
    body = F.unhex(F.get(F.array(*bodies), kind.cast("int")))
    sized = captioned(spark, sf_dir).select("doc_id", kind.alias("kind"), body.alias("image")).withColumn("s", images.image_size(F.col("image")))
    return sized.select("doc_id", "kind", "s.width", "s.height")


@query("filter_python", "SELECT doc_id, lang FROM documents WHERE n_chars % 3 = 1 AND lang <> 'fr'")
def filter_python(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    kept = filters.filter_python(rows, lambda row, part: row["n_chars"] % 3 == part, ["n_chars"], part=1)
    return filters.filter_python(kept, lambda c: [lang != "fr" for lang in c["lang"]], ["lang"], batched=True).select("doc_id", "lang")


_PHASE = S.phase(f"({S.dims()})")


@query("phase_dims", f"SELECT doc_id, height, width FROM ({_PHASE})")
def phase_dims(spark, sf_dir):
    dims = captioned(spark, sf_dir).select("doc_id", shapes.phase_dims(F.col("h"), F.col("w")).alias("d"))
    return dims.select("doc_id", "d.height", "d.width")


@query("phase_row", f"""SELECT doc_id, height, width, round(width / height, 6) AS aspect_ratio,
  CAST(height AS VARCHAR) || 'x' || CAST(width AS VARCHAR) AS bucket_size FROM ({_PHASE}) WHERE height IS NOT NULL""")
def phase_row(spark, sf_dir):
    rows = training_set.assign_buckets(captioned(spark, sf_dir), "h", "w")
    return rows.select("doc_id", "height", "width", F.round("aspect_ratio", 6).alias("aspect_ratio"), "bucket_size")


@query("cap_longest_side", f"""SELECT doc_id,
  CASE WHEN w > h THEN (CASE WHEN w > 512 THEN 512 ELSE w END) ELSE (CASE WHEN h > 512 THEN CAST(trunc(w / h * 512) AS INTEGER) ELSE w END) END AS width,
  CASE WHEN w > h THEN (CASE WHEN w > 512 THEN CAST(trunc(h / w * 512) AS INTEGER) ELSE h END) ELSE (CASE WHEN h > 512 THEN 512 ELSE h END) END AS height
  FROM ({S.dims()})""")
def cap_longest_side(spark, sf_dir):
    capped = captioned(spark, sf_dir).select("doc_id", shapes.cap_longest_side(F.col("w"), F.col("h")).alias("s"))
    return capped.select("doc_id", "s.width", "s.height")


@query("ceil_multiple", "SELECT doc_id, ((n_chars + 31) // 32) * 32 AS padded FROM documents")
def ceil_multiple(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shapes.ceil_multiple(F.col("n_chars"), 32).alias("padded"))


@query("pow2_dim", f"""SELECT doc_id, CAST((SELECT max(p) FROM (SELECT 1 << i AS p FROM range(31) r(i)) WHERE p <= h) AS INTEGER) AS down,
  CAST((SELECT min(p) FROM (SELECT 1 << i AS p FROM range(31) r(i)) WHERE p >= h) AS BIGINT) AS up FROM ({S.dims()})""")
def pow2_dim(spark, sf_dir):
    return captioned(spark, sf_dir).select(
        "doc_id", shapes.pow2_down(F.col("h")).alias("down"), shapes.pow2_up(F.col("h")).alias("up"))


@query("token_count", f"""SELECT height, width, count(*) AS n, CAST(sum(ceil((height // 8) / 2) * ceil((width // 8) / 2)) AS BIGINT) AS tokens
  FROM ({_PHASE}) WHERE height IS NOT NULL GROUP BY height, width""")
def token_count(spark, sf_dir):
    rows = training_set.assign_buckets(captioned(spark, sf_dir), "h", "w")
    tokens = shapes.token_count(F.col("height"), F.col("width"))
    return rows.groupBy("height", "width").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"))


# ---- flagship ----

@query("training_rows_per_bucket", f"""WITH c AS ({_CLEAN}), p AS ({S.phase("(SELECT * FROM c WHERE " + _KEPT + ")")})
  SELECT CAST(height AS VARCHAR) || 'x' || CAST(width AS VARCHAR) AS bucket_size, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM p WHERE height IS NOT NULL), 9) AS share FROM p WHERE height IS NOT NULL GROUP BY height, width""")
def training_rows_per_bucket(spark, sf_dir):
    rows = training_set.build(captioned(spark, sf_dir), "h", "w")
    return training_set.rows_per_bucket(rows).withColumn("share", F.round("share", 9))
