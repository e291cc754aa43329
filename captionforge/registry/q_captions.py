"""Caption text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.functions import captions as C
from captionforge.registry import query, sqltext as S, table
from captionforge.registry.inputs import CAPTIONED, GENERATED, captioned, generated


@query("strip_openings_all", f"SELECT doc_id, {S.strip_all('recaption')} AS recaption FROM ({CAPTIONED})")
def strip_openings_all(spark, sf_dir):
    return captioned(spark, sf_dir).select("doc_id", C.strip_openings_all(F.col("recaption")).alias("recaption"))


@query("capitalize", f"SELECT doc_id, {S.capitalize('recaption')} AS recaption FROM ({CAPTIONED})")
def capitalize(spark, sf_dir):
    return captioned(spark, sf_dir).select("doc_id", C.capitalize(F.col("recaption")).alias("recaption"))


_FOLD, _LAST = S.fold_ctes("g", "caption")


@query("strip_openings_fold",
       f"WITH g AS (SELECT doc_id, caption FROM ({GENERATED})), {_FOLD} SELECT doc_id, {S.trim('caption')} AS caption FROM {_LAST}")
def strip_openings_fold(spark, sf_dir):
    return generated(spark, sf_dir).select("doc_id", C.strip_openings_fold(F.col("caption")).alias("caption"))


@query("caption_repeats", f"SELECT doc_id, CAST({S.repeats('caption')} AS BIGINT) AS repeats FROM ({GENERATED})")
def caption_repeats(spark, sf_dir):
    return generated(spark, sf_dir).select("doc_id", C.caption_repeats(F.col("caption")).alias("repeats"))


_REJECT = f"{S.repeats('caption')} > 5 OR len(list_distinct({S.words('caption')})) < 3"


@query("caption_reject", f"SELECT doc_id, CASE WHEN NOT ({_REJECT}) THEN caption END AS caption FROM ({GENERATED})")
def caption_reject(spark, sf_dir):
    return generated(spark, sf_dir).select("doc_id", C.caption_reject(F.col("caption")).alias("caption"))


def _filled(template: str, column: str) -> str:
    before, after = template.split("{}")
    return f"{S.quote(before)} || {column} || {S.quote(after)}"


@query("prompt_template", f"""SELECT doc_id, {_filled(C.LONG_CAPTION_PROMPT, 'text')} AS long_prompt,
  {_filled(C.SHORT_CAPTION_PROMPT, 'text')} AS short_prompt, 'user' AS second_role FROM documents""")
def prompt_template(spark, sf_dir):
    text = F.col("text")
    messages = C.short_caption_messages(text)
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.long_caption_prompt(text).alias("long_prompt"),
        F.get(messages, 1)["content"].alias("short_prompt"), F.get(messages, 1)["role"].alias("second_role"),
    )


_ARTICLES = f"CASE WHEN {S.uniform(11, 'doc_id', S.quote('article'))} < 0.5 THEN replace(replace(recaption, 'A ', ''), 'An ', '') ELSE recaption END"


@query("clean_text", f"""WITH s AS MATERIALIZED (SELECT doc_id, {S.strip_all(_ARTICLES)} AS t FROM ({CAPTIONED}))
  SELECT doc_id, coalesce(CASE WHEN right(t, 1) IN ('.', ',', '!', '?') AND {S.uniform(11, 'doc_id', S.quote('mark'))} < 0.5
    THEN {S.trim("left(t, length(t) - 1)")} ELSE t END, '') AS recaption FROM s""")
def clean_text(spark, sf_dir):
    return captioned(spark, sf_dir).select(
        "doc_id", C.clean_text(F.col("recaption"), 11, F.col("doc_id")).alias("recaption"))


@query("trim_text", f"SELECT doc_id, {S.trim('caption')} AS caption FROM ({GENERATED})")
def trim_text(spark, sf_dir):
    return generated(spark, sf_dir).select("doc_id", C.trim_text(F.col("caption")).alias("caption"))


_URL_STEM = r"regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1)"


@query("stem_parts", f"""SELECT page_id, {_URL_STEM} AS stem, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext,
  split_part({_URL_STEM}, '_', 1) AS prefix FROM (SELECT page_id, url || '/n' || page_id || '_' || length(html) || '.PNG' AS path FROM pages)""")
def stem_parts(spark, sf_dir):
    path = F.concat(F.col("url"), F.lit("/n"), F.col("page_id"), F.lit("_"), F.length("html"), F.lit(".PNG"))
    stem = C.file_stem(path)
    return table(spark, sf_dir, "pages").select(
        "page_id", stem.alias("stem"), C.file_extension(path).alias("ext"), C.stem_prefix(stem).alias("prefix"))


@query("bucket_string", f"SELECT doc_id, CAST(h AS VARCHAR) || 'x' || CAST(w AS VARCHAR) AS bucket_size, h AS first_side, w AS second_side FROM ({S.dims()})")
def bucket_string(spark, sf_dir):
    bucket = C.bucket_string(F.col("h"), F.col("w"))
    first, second = C.bucket_sides(bucket)
    return captioned(spark, sf_dir).select(
        "doc_id", bucket.alias("bucket_size"), first.alias("first_side"), second.alias("second_side"))


@query("shard_name", "SELECT doc_id, printf('train-%05d-of-%05d', doc_id, n_chars) AS file_name FROM documents")
def shard_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.shard_file_name("train", F.col("doc_id"), F.col("n_chars")).alias("file_name"))


def synonym_sql(names: str) -> str:
    return (f"list_transform(list_filter(string_split({names}, ','), lambda x: {S.trim('x')} <> ''), "
            f"lambda x: replace({S.trim('x')}, '\"', ''))")


_NAMES = "replace(p_name, ' ', ' , \"') || ',' || p_type || ', '"


@query("class_caption", f"""SELECT p_partkey, 'a photo of a ' || list_extract(s, 1 + CAST(trunc({S.uniform(5, 'p_partkey')} * len(s)) AS INTEGER)) AS caption
  FROM (SELECT p_partkey, {synonym_sql(_NAMES)} AS s FROM part)""")
def class_caption(spark, sf_dir):
    names = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(' , "')), F.lit(","), F.col("p_type"), F.lit(", "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.class_caption(names, 5, F.col("p_partkey")).alias("caption"))
