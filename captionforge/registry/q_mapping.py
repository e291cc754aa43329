"""Maps, plugged-in models (deterministic stand-ins), fetching, user functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from captionforge.functions import captions as C, shapes
from captionforge.operators import mapping as M, models
from captionforge.operators.positions import with_row_index
from captionforge.registry import query, sqltext as S, table
from captionforge.registry.inputs import CAPTIONED, GENERATED, captioned, generated
from captionforge.session import scratch_path


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


@query("map_rows", "SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS twice FROM documents")
def map_rows(spark, sf_dir):
    return M.map_rows(_docs(spark, sf_dir), lambda r: {"lang": r["lang"].upper(), "twice": r["n_chars"] * 2},
                      "lang string, twice long", remove_columns=["n_chars"])


@query("map_columns", "SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS twice FROM documents")
def map_columns(spark, sf_dir):
    return M.map_columns(_docs(spark, sf_dir), {"lang": F.upper("lang"), "twice": F.col("n_chars") * 2}, ["n_chars"])


@query("map_batches", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 400 UNION ALL SELECT doc_id, lang || '!', n_chars FROM documents WHERE n_chars > 400")
def map_batches(spark, sf_dir):
    def twice(batch: pd.DataFrame) -> pd.DataFrame:
        long = batch[batch["n_chars"] > 400]
        return pd.concat([long, long.assign(lang=long["lang"] + "!")])

    docs = _docs(spark, sf_dir)
    return M.map_batches(docs, twice, docs.schema)


@query("map_exact_batches", "SELECT i // 64 AS batch_no, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) GROUP BY i // 64 HAVING count(*) = 64")
def map_exact_batches(spark, sf_dir):
    rows = with_row_index(_docs(spark, sf_dir), ["doc_id"])

    def total(batch: pd.DataFrame) -> pd.DataFrame:
        if batch.empty:
            return pd.DataFrame({"batch_no": [], "chars": []})
        return pd.DataFrame({"batch_no": [batch["row_idx"].iloc[0] // 64], "chars": [batch["n_chars"].sum()]})

    return M.map_exact_batches(rows, ["doc_id"], total, "batch_no long, chars long", 64, drop_last_batch=True)


_FOLD, _LAST = S.fold_ctes("g", "caption")


@query("recaption_job", f"""WITH g AS (SELECT doc_id, 'The image shows ' || caption AS caption FROM ({GENERATED})), {_FOLD},
  t AS (SELECT doc_id, {S.trim('caption')} AS caption FROM {_LAST})
  SELECT doc_id, caption AS recaption, 'Short: ' || caption AS recaption_short FROM t WHERE NOT ({S.repeats('caption')} > 5 OR len(list_distinct({S.words('caption')})) < 3)""")
def recaption_job(spark, sf_dir):
    rows = generated(spark, sf_dir).withColumn("image", F.unhex(F.lit("00")))
    done = models.recaption(rows, "caption", "image", models.echo_prompt("The image shows "), models.echo_prompt("Short: "))
    return done.select("doc_id", "recaption", "recaption_short")


def _encoder(part: str, width: int, offset: int) -> str:
    """Hashed-word counts over their Euclidean norm, as (doc_id, part, i, x) rows."""
    return f"""SELECT doc_id, '{part}' AS part, k + {offset} AS i, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM
      (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % {width} AS k, count(*)::DOUBLE AS n FROM w GROUP BY ALL)"""


@query("encode_text_job", f"""WITH w AS MATERIALIZED (SELECT doc_id, word FROM (SELECT doc_id, unnest({S.words('text')}) AS word FROM documents) WHERE word <> ''),
  e AS ({_encoder('states', 24, 0)} UNION ALL {_encoder('states', 16, 24)} UNION ALL {_encoder('pooled', 8, 0)})
  SELECT doc_id, part, CAST(r.i AS INTEGER) AS i, round(coalesce(e.x, 0), 6) AS x
  FROM (SELECT doc_id, 'states' AS part, i FROM documents, range(48) g(i) UNION ALL SELECT doc_id, 'pooled', i FROM documents, range(8) g(i)) r LEFT JOIN e USING (doc_id, part, i)""")
def encode_text_job(spark, sf_dir):
    """Hashed-word stand-ins for the three encoders over whole texts, one row per vector element."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = models.encode_text(docs, "text", models.hashed_words(24), models.hashed_words(16), models.hashed_words(8))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"text_{p}").alias("v")) for p in ("states", "pooled")])
    rows = coded.select("doc_id", F.inline(parts)).select("doc_id", "part", F.posexplode("v").alias("i", "x"))
    return rows.withColumn("x", F.round("x", 6))


def _byte_shares(batch: pd.DataFrame) -> pd.Series:
    """Stand-in classifier: share of each leading hex digit of the byte values."""
    def shares(body: bytes) -> np.ndarray:
        values = np.frombuffer(body, dtype=np.uint8) >> 4
        return np.bincount(values, minlength=16) / max(len(values), 1)

    return batch["image"].map(shares)


@query("feature_job", """WITH h AS (SELECT page_id, hex(encode(html)) AS h FROM pages),
  d AS (SELECT page_id, length(h) // 2 AS n, substr(h, p + 1, 1) AS digit FROM (SELECT page_id, h, unnest(range(0, length(h), 2)) AS p FROM h)),
  c AS (SELECT page_id, CAST('0x' || digit AS INTEGER) AS i, count(*) / any_value(n) AS x FROM d GROUP BY page_id, digit)
  SELECT page_id, CAST(g.i AS INTEGER) AS i, round(coalesce(x, 0), 6) AS x FROM pages CROSS JOIN range(16) g(i) LEFT JOIN c USING (page_id, i)""")
def feature_job(spark, sf_dir):
    """Classifier features of every page body, one row per feature."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    coded = models.image_features(pages, "body", lambda: _byte_shares)
    return coded.select("page_id", F.posexplode("features").alias("i", "x")).withColumn("x", F.round("x", 6))


def _stub_fetcher():
    """Status by the length of the address; some failures clear up after two attempts."""
    def get(url: str, attempt: int):
        kind = len(url) % 7
        if kind == 3:
            return 404, None
        if kind == 4:
            return (200, url.encode()) if attempt >= 2 else (503, None)
        if kind == 5:
            raise OSError("connection reset")
        return 200, url.encode()

    return get


@query("fetch_job", """SELECT page_id, CASE WHEN length(url) % 7 IN (3, 5) THEN NULL ELSE url END AS body,
  CAST(CASE length(url) % 7 WHEN 3 THEN 404 WHEN 5 THEN NULL ELSE 200 END AS INTEGER) AS status,
  CAST(CASE length(url) % 7 WHEN 4 THEN 3 WHEN 5 THEN 7 ELSE 1 END AS INTEGER) AS attempts FROM pages""")
def fetch_job(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    done = models.fetch(pages, "url", _stub_fetcher)
    return done.select("page_id", F.decode("content", "UTF-8").alias("body"), "status", "attempts")


@query("fetch_triage", """SELECT event_id, CASE WHEN s BETWEEN 200 AND 399 THEN 'keep' WHEN s IN (400, 401, 402, 403, 404) OR a > 5 THEN 'give_up' ELSE 'retry' END AS verdict
  FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(200 + 100 * (user_id % 4) + event_id % 6 AS INTEGER) END AS s, event_id % 8 AS a FROM events)""")
def fetch_triage(spark, sf_dir):
    status = F.when(F.col("event_type") != "error", (200 + 100 * (F.col("user_id") % 4) + F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", models.fetch_triage(status, F.col("event_id") % 8).alias("verdict"))


@query("resize_job", f"""SELECT p.doc_id, height, width, 'h' || height || 'w' || width || reverse(recaption_short) AS image
  FROM ({S.phase(f'({S.dims()})')}) p JOIN ({CAPTIONED}) c ON c.doc_id = p.doc_id WHERE height IS NOT NULL""")
def resize_job(spark, sf_dir):
    def codec():
        return lambda b: ("h" + b["height"].astype(str) + "w" + b["width"].astype(str) + b["image"].map(lambda i: bytes(i).decode()[::-1])).map(str.encode)

    rows = captioned(spark, sf_dir).select("doc_id", "h", "w", F.encode("recaption_short", "UTF-8").alias("image"))
    done = models.resize_images(rows, "h", "w", "image", codec)
    return done.select("doc_id", "height", "width", F.decode("image", "UTF-8").alias("image"))


# ---- user functions ----

@query("udf_row", "SELECT doc_id, lang || ':' || n_chars AS tag FROM documents")
def udf_row(spark, sf_dir):
    tag = M.row_function(lambda lang, n: f"{lang}:{n}", "string")
    return _docs(spark, sf_dir).select("doc_id", tag("lang", "n_chars").alias("tag"))


@query("udf_batch", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings")
def udf_batch(spark, sf_dir):
    @F.pandas_udf("double")
    def norm(v: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(np.stack(v.to_numpy()).astype(np.float64), axis=1))

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm("embedding"), 5).alias("norm"))


@query("udf_indices_rank", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 + 100 AS place, true AS ranked FROM documents")
def udf_indices_rank(spark, sf_dir):
    def place(batch: pd.DataFrame, indices: pd.Series, rank: int, offset: int) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "place": indices + offset, "ranked": rank >= 0})

    return M.map_with_context(_docs(spark, sf_dir), ["doc_id"], place, "doc_id long, place long, ranked boolean",
                              input_columns=["doc_id"], with_rank=True, offset=100)


@query("udf_explode", "SELECT doc_id, unnest(string_split(source, 's')) AS piece FROM documents")
def udf_explode(spark, sf_dir):
    def pieces(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(piece=batch["source"].str.split("s"))[["doc_id", "piece"]].explode("piece")

    return M.map_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), pieces, "doc_id long, piece string")


@query("udaf_merge", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def udaf_merge(spark, sf_dir):
    """Per-batch Python partials, merged by Spark: only partials cross the shuffle."""
    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.groupby("event_type")["value"].agg(n="size", total="sum").reset_index()

    parts = M.map_batches(table(spark, sf_dir, "events").select("event_type", "value"), partial,
                          "event_type string, n long, total double")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


_SMALLEST = 64


@query("udaf_sketch", f"""WITH u AS (SELECT DISTINCT event_type, {S.uniform(23, 'user_id')} AS h FROM events),
  r AS (SELECT event_type, h, row_number() OVER (PARTITION BY event_type ORDER BY h) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM u)
  SELECT event_type, CASE WHEN any_value(c) < {_SMALLEST} THEN any_value(c)::DOUBLE ELSE round(({_SMALLEST} - 1) / max(h) FILTER (i <= {_SMALLEST}), 4) END AS users,
  least(any_value(c), {_SMALLEST}) AS kept FROM r GROUP BY event_type""")
def udaf_sketch(spark, sf_dir):
    """Distinct users per event type from the smallest hashes: a state that cannot be added up."""
    def update(state, rows):
        drawn = (int(hashlib.md5(f"23|{u}".encode()).hexdigest()[:13], 16) / 4503599627370496.0 for u in rows["user_id"].unique())
        return merge(state or [], drawn)

    def merge(a, b):
        return sorted({*a, *b})[:_SMALLEST]

    def finish(state):
        return round((_SMALLEST - 1) / state[-1], 4) if len(state) == _SMALLEST else float(len(state)), len(state)

    events = table(spark, sf_dir, "events").select("event_type", "user_id")
    return M.aggregate_state(events, ["event_type"], update, merge, finish, "users double, kept long")


@query("lazy_transform", "SELECT doc_id, upper(lang) AS lang, n_chars FROM documents WHERE n_chars > 400")
def lazy_transform(spark, sf_dir):
    steps = M.lazy_transform(lambda d: d.where(F.col("n_chars") > 400), lambda d: d.withColumn("lang", F.upper("lang")))
    return _docs(spark, sf_dir).transform(steps)


@query("map_cache", "SELECT doc_id, upper(lang) AS lang, n_chars FROM documents")
def map_cache(spark, sf_dir):
    cache = scratch_path(spark, "map-cache")
    step = lambda d: d.withColumn("lang", F.upper("lang"))
    M.cached_map(_docs(spark, sf_dir), step, cache, "upper-lang-1")
    return M.cached_map(_docs(spark, sf_dir), step, cache, "upper-lang-1")


@query("map_rows_nullable", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 9007199254740993 + doc_id END AS big,
  CASE WHEN doc_id % 2 = 0 THEN 9007199254740993 + doc_id * 2 END AS twice FROM documents""")
def map_rows_nullable(spark, sf_dir):
    big = F.when(F.col("doc_id") % 3 > 0, F.lit(9007199254740993) + F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", big.alias("big"))
    return M.map_rows(rows, lambda r: {"twice": 9007199254740993 + r["doc_id"] * 2} if r["doc_id"] % 2 == 0 else None, "twice long")


@query("map_batches_nullable", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 9007199254740993 + doc_id END AS big FROM documents WHERE doc_id % 5 > 0")
def map_batches_nullable(spark, sf_dir):
    big = F.when(F.col("doc_id") % 3 > 0, F.lit(9007199254740993) + F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", big.alias("big"))
    return M.map_batches(rows, lambda batch: batch[batch["doc_id"] % 5 > 0], rows.schema)


@query("fetch_nullable", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 9007199254740993 + page_id END AS big, strlen(url) AS size, 1 AS attempts FROM pages")
def fetch_nullable(spark, sf_dir):
    big = F.when(F.col("page_id") % 3 > 0, F.lit(9007199254740993) + F.col("page_id"))
    rows = table(spark, sf_dir, "pages").select("page_id", big.alias("big"), "url")
    done = models.fetch(rows, "url", lambda: lambda address, attempt: (200, address.encode()), threads=4)
    return done.select("page_id", "big", F.octet_length("content").cast("long").alias("size"), "attempts")
