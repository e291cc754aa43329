"""Sources and sinks: tables are written in the format under test and read back."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.captions import file_stem
from captionforge.operators.positions import rows_per_file, with_row_index
from captionforge.operators.splits import from_splits
from captionforge.plans import publish
from captionforge.registry import query, table
from captionforge.session import scratch_path
from captionforge.sinks import writers as W
from captionforge.sources import archives, readers as R


@query("src_parquet", "SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber")
def src_parquet(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    # a file for each task that reads the table
    W.write_parquet(table(spark, sf_dir, "lineitem"), path)
    lines = R.read_parquet(spark, path, columns=["l_orderkey", "l_linenumber", "l_quantity"])
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("src_parquet_schema", "SELECT doc_id, lang, source FROM documents")
def src_parquet_schema(spark, sf_dir):
    declared = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                             T.StructField("source", T.StringType())])
    return R.read_parquet(spark, f"{sf_dir}/documents.parquet", schema=declared)


@query("src_drop_pandas_index", "SELECT doc_id, quality, toxic FROM labels")
def src_drop_pandas_index(spark, sf_dir):
    from captionforge.operators.schema import drop_pandas_index

    labels = table(spark, sf_dir, "labels").withColumn("__index_level_0__", F.col("doc_id") * 2)
    return drop_pandas_index(drop_pandas_index(labels))


@query("src_jsonl", "SELECT CAST(doc_id AS VARCHAR) AS key, text AS caption_llava, source AS caption_llava_short FROM documents")
def src_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    W.write_json(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("caption_llava"),
                             F.col("source").alias("caption_llava_short"), "lang"), path)
    return R.read_jsonl(spark, path, "key string, caption_llava string, caption_llava_short string, lang string",
                        ["key", "caption_llava", "caption_llava_short"])


@query("src_json_field", "SELECT conv_id, turn, text FROM conversations")
def src_json_field(spark, sf_dir):
    path = scratch_path(spark, "jsonfield")
    # JSON documents with fifty rows each under "data"
    rows = with_row_index(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    documents = rows.groupBy(rows_per_file(F.col("row_idx"), 50)).agg(
        F.collect_list(F.struct("conv_id", "turn", "text")).alias("data"))
    documents.select("data").write.json(path)
    return R.read_jsonl(spark, path, "data array<struct<conv_id: bigint, turn: bigint, text: string>>").select(F.inline("data"))


@query("src_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    W.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return R.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")


@query("src_tsv", "SELECT source AS url, text AS caption FROM documents")
def src_tsv(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.col("text").alias("caption"))
    W.write_csv(docs, path, sep="\t")
    return R.read_csv(spark, path, "url string, caption string", sep="\t", multi_line=True)


@query("src_text", "SELECT line AS text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def src_text(spark, sf_dir):
    path = scratch_path(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.option("lineSep", "\n").text(path)
    return R.read_text(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("src_class_list", "SELECT CAST(p_partkey AS INTEGER) AS class_id, p_name || ', ' || p_type AS names FROM part")
def src_class_list(spark, sf_dir):
    """Half of the classes in each of the two line forms."""
    path = scratch_path(spark, "classes")
    names = F.concat_ws(", ", "p_name", "p_type")
    quoted = F.concat(F.lit(" "), F.col("p_partkey"), F.lit(": '"), names, F.lit("',"))
    plain = F.concat(F.col("p_partkey"), F.lit(" "), names)
    lines = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, quoted).otherwise(plain).alias("value"))
    lines.write.text(path)
    return R.parse_class_list(R.read_text(spark, path))


@query("src_sql", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def src_sql(spark, sf_dir):
    return R.read_sql(spark, "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM {orders} "
                             "WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", orders=table(spark, sf_dir, "orders"))


@query("src_memory", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def src_memory(spark, sf_dir):
    """The two fixed-size lookup tables through driver memory, then joined to customers."""
    nations = R.from_memory(spark, W.to_local(table(spark, sf_dir, "nation"), "pandas"))
    regions = R.from_memory(spark, W.to_local(table(spark, sf_dir, "region"), "dict"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("src_generator", "SELECT doc_id, part FROM documents, range(3) r(part)")
def src_generator(spark, sf_dir):
    """Every document id generated once per part by its own task."""
    n = table(spark, sf_dir, "documents").count()

    def ids(part: int, n: int):
        for i in range(n):
            yield {"doc_id": i, "part": part}

    return R.from_generator(spark, ids, "doc_id long, part long", [{"part": p, "n": n} for p in range(3)])


@query("src_spark", "SELECT doc_id, quality, toxic FROM labels")
def src_spark(spark, sf_dir):
    return R.from_spark(table(spark, sf_dir, "labels"))


_SHARDS = 6
_DIV, _MOD = f"(count(*) OVER () // {_SHARDS})", f"(count(*) OVER () % {_SHARDS})"
_SHARD_OF = f"""SELECT doc_id, lang, i AS row_idx, printf('data-%05d-of-%05d', CASE WHEN i < m * (d + 1) THEN i // (d + 1) ELSE m + (i - m * (d + 1)) // d END, {_SHARDS}) AS shard
  FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, {_DIV} AS d, {_MOD} AS m FROM documents)"""


@query("src_saved", f"SELECT doc_id, lang, row_idx, shard FROM ({_SHARD_OF})")
def src_saved(spark, sf_dir):
    path = scratch_path(spark, "saved")
    W.save_sharded(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], path, num_shards=_SHARDS)
    return W.load_saved(spark, path).select("doc_id", "lang", "row_idx", "shard")


@query("sink_sharded", f"SELECT shard, count(*) AS n_rows FROM ({_SHARD_OF}) GROUP BY shard")
def sink_sharded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    manifest = W.save_sharded(docs, ["doc_id"], scratch_path(spark, "sharded"), num_shards=_SHARDS)
    return manifest.select("shard", "n_rows")


_BYTES = "8 + strlen(text) + 4 + strlen(lang) + 4 + strlen(source) + 4 + 8"


@query("sink_sharded_by_size", f"""WITH t AS (SELECT count(*) AS n, CAST(trunc(sum({_BYTES}) / 200000) AS BIGINT) + 1 AS s FROM documents),
  r AS (SELECT {_BYTES} AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i, n // s AS d, n % s AS m, s FROM documents, t)
  SELECT printf('data-%05d-of-%05d', CASE WHEN i < m * (d + 1) THEN i // (d + 1) ELSE m + (i - m * (d + 1)) // d END, s) AS shard,
  count(*) AS n_rows, CAST(sum(b) AS BIGINT) AS n_bytes FROM r GROUP BY 1""")
def sink_sharded_by_size(spark, sf_dir):
    """Shards of at most 200 kB of whole documents, with their sizes."""
    docs = table(spark, sf_dir, "documents")
    return W.save_sharded(docs, ["doc_id"], scratch_path(spark, "sharded"), max_shard_size="200KB")


def _tar(rows: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for page_id, html, meta in zip(rows["page_id"], rows["html"], rows["meta"]):
            members = [(f"{page_id}.png", html.encode())] + ([(f"{page_id}.json", meta.encode())] if meta else [])
            for name, body in members:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    return pd.DataFrame({"path": [f"/part/{rows['archive'].iloc[0]}.tar"], "content": [out.getvalue()]})


def _archives(spark, sf_dir):
    """pages packed 25 to an archive: the body as image member, metadata beside most of them."""
    status = F.when(F.length("url") % 5 == 0, "failed_to_download").otherwise("success")
    meta = F.to_json(F.struct(F.col("page_id").cast("string").alias("key"), "url", status.alias("status"),
                              (F.length("url") / 100).alias("similarity")))
    pages = with_row_index(table(spark, sf_dir, "pages"), ["page_id"]).select(
        "page_id", "html", F.when(F.length("url") % 6 != 0, meta).alias("meta"),
        rows_per_file(F.col("row_idx"), 25).alias("archive"))
    return pages.groupBy("archive").applyInPandas(_tar, "path string, content binary")


_META = """'{"key":"' || page_id || '","url":"' || url || '","status":"' || CASE WHEN length(url) % 5 = 0 THEN 'failed_to_download' ELSE 'success' END
    || '","similarity":' || CAST(length(url) / 100 AS VARCHAR) || '}'"""


@query("src_tar_members", f"""SELECT '/part/' || p || '.tar' AS archive, page_id || '.' || ext AS member, CAST(page_id AS VARCHAR) AS stem, ext,
    CASE ext WHEN 'png' THEN strlen(html) ELSE strlen({_META}) END AS n_bytes
    FROM (SELECT *, (row_number() OVER (ORDER BY page_id) - 1) // 25 AS p FROM pages), (VALUES ('png'), ('json')) e(ext)
    WHERE ext = 'png' OR length(url) % 6 <> 0""")
def src_tar_members(spark, sf_dir):
    members = archives.tar_members(_archives(spark, sf_dir))
    return members.select("archive", "member", "stem", "ext", F.octet_length("content").cast("long").alias("n_bytes"))


@query("join_sidecar", """SELECT CAST(page_id AS VARCHAR) AS key, url, round(length(url) / 100, 6) AS similarity, html AS image FROM pages
  WHERE length(url) % 6 <> 0 AND length(url) % 5 <> 0""")
def join_sidecar(spark, sf_dir):
    members = archives.tar_members(_archives(spark, sf_dir))
    pairs = archives.join_sidecar(members, "key string, url string, status string, similarity double")
    return publish.successful_pairs(pairs).select("key", "url", F.round("similarity", 6).alias("similarity"), F.decode("image", "UTF-8").alias("image"))


@query("archive_pairs", """SELECT CAST(page_id AS VARCHAR) AS key, url, round(length(url) / 100, 6) AS similarity, html AS image FROM pages
  WHERE length(url) % 6 <> 0 AND length(url) % 5 <> 0""")
def archive_pairs(spark, sf_dir):
    """The pairs of join_sidecar, made where an archive is unpacked."""
    pairs = archives.archive_pairs(_archives(spark, sf_dir), "key string, url string, status string, similarity double")
    return publish.successful_pairs(pairs).select("key", "url", F.round("similarity", 6).alias("similarity"), F.decode("image", "UTF-8").alias("image"))


@query("src_tar_files", f"""SELECT p || '.tar' AS archive, page_id || '.' || ext AS member,
    CASE ext WHEN 'png' THEN strlen(html) ELSE strlen({_META}) END AS n_bytes
    FROM (SELECT *, (row_number() OVER (ORDER BY page_id) - 1) // 25 AS p FROM pages), (VALUES ('png'), ('json')) e(ext)
    WHERE ext = 'png' OR length(url) % 6 <> 0""")
def src_tar_files(spark, sf_dir):
    """Archives written as files, then read by ranges of members."""
    folder = scratch_path(spark, "tars")

    def write(batches):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(place, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with system.open_output_stream(f"{place}/{path.rsplit('/', 1)[-1]}") as out:
                    out.write(content)
            yield batch[["path"]]

    _archives(spark, sf_dir).mapInPandas(write, "path string").count()
    members = archives.read_archives(spark, folder)
    return members.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "member", F.octet_length("content").cast("long").alias("n_bytes"))


@query("saved_splits", """SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
  doc_id, lang, text FROM documents""")
def saved_splits(spark, sf_dir):
    """Three splits saved as a second version, over a first one that held something else, and loaded."""
    path = scratch_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    name = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    W.save_splits({"train": docs.where("doc_id % 10 = 9")}, path, ["doc_id"], num_shards=2)
    W.save_splits({s: docs.where(name == s) for s in ("train", "validation", "test")}, path, ["doc_id"], max_shard_size="1MB")
    return from_splits(W.load_splits(spark, path)).select("split", "doc_id", "lang", "text")


@query("src_image_folder", "SELECT 'n' || (page_id % 7) AS class, page_id || '.jpg' AS name, strlen(html) AS n_bytes FROM pages WHERE length(url) % 4 <> 0")
def src_image_folder(spark, sf_dir):
    """Page bodies as files below class folders; some are no images by suffix."""
    suffix = F.when(F.length("url") % 4 == 0, ".txt").otherwise(".JPG")
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/data/n"), F.col("page_id") % 7, F.lit("/"), F.col("page_id"), suffix).alias("path"),
        F.encode("html", "UTF-8").alias("content"))
    images = R.image_rows(files)
    return images.select("class", F.concat(file_stem(F.col("path")), F.lit(".jpg")).alias("name"),
                         F.octet_length("content").cast("long").alias("n_bytes"))


@query("src_url_list", "SELECT url, html AS caption, page_id, (row_number() OVER (ORDER BY page_id) - 1) // 100 AS shard FROM pages")
def src_url_list(spark, sf_dir):
    return R.url_list(table(spark, sf_dir, "pages"), "url", "html", ["page_id"], ["page_id"], per_shard=100)


@query("meta_shape", "SELECT count(*) AS num_rows, 5 AS num_columns, 'doc_id,text,lang,source,n_chars' AS column_names, 'struct<doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint>' AS features FROM documents")
def meta_shape(spark, sf_dir):
    return R.table_shape(table(spark, sf_dir, "documents"))


@query("meta_split_shapes", "SELECT lang AS split, count(*) AS num_rows FROM documents GROUP BY lang")
def meta_split_shapes(spark, sf_dir):
    return R.split_shapes(table(spark, sf_dir, "documents").withColumnRenamed("lang", "split"))


# ---- sinks ----

@query("sink_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "out")
    W.write_parquet(table(spark, sf_dir, "documents"), path)
    return R.read_parquet(spark, path)


@query("sink_csv", "SELECT doc_id, text, lang FROM documents")
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "out")
    W.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return R.read_csv(spark, path, "doc_id long, text string, lang string", multi_line=True)


@query("sink_json", "SELECT doc_id, quality, CASE WHEN quality = 1 THEN toxic END AS toxic FROM labels")
def sink_json(spark, sf_dir):
    path = scratch_path(spark, "out")
    W.write_json(table(spark, sf_dir, "labels").withColumn("toxic", F.when(F.col("quality") == 1, F.col("toxic"))), path)
    return R.read_jsonl(spark, path, "doc_id long, quality int, toxic int")


@query("sink_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sink_sql(spark, sf_dir):
    path = scratch_path(spark, "table")
    name = "saved_orders_" + path.rsplit("-", 1)[1]
    W.write_table(table(spark, sf_dir, "orders"), name, path)
    return spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("sink_local", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def sink_local(spark, sf_dir):
    """A small result (one row per status and priority) to the driver in batches, and back."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    pieces = list(W.local_batches(counts, 4))
    return R.from_memory(spark, pd.concat(pieces), "o_orderstatus string, o_orderpriority string, n long")


@query("sink_publish_plan", """SELECT g AS push_group, g * 15 + i AS shard_no, printf('train-%05d-of-%05d.parquet', g * 15 + i, (n // 15 + 1) * 15) AS file_name
  FROM (SELECT count(*) AS n FROM documents) d, range(0, (SELECT count(*) // 15 + 1 FROM documents)) p(g), range(15) q(i)
  WHERE g >= (SELECT count(*) FROM labels) // 15 AND g * 15 + i NOT IN (SELECT doc_id FROM labels)""")
def sink_publish_plan(spark, sf_dir):
    """One shard per document; the labelled documents' shards are in the ledger."""
    n, done = table(spark, sf_dir, "documents").count(), table(spark, sf_dir, "labels").count()
    end = (n // 15 + 1) * 15
    ledger = table(spark, sf_dir, "labels").select(F.format_string("train-%05d-of-%05d.parquet", "doc_id", F.lit(end)).alias("file_name"))
    return W.publish_plan(spark, n, 15, done, ledger=ledger)


@query("sink_rows_per_file", "SELECT o_orderkey, i // 1024 AS caption_file, i // 10000 AS url_file, i // 1000 AS range_file, i // 25 AS archive_shard FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def sink_rows_per_file(spark, sf_dir):
    rows = with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    i = F.col("row_idx")
    return rows.select("o_orderkey", rows_per_file(i, 1024).alias("caption_file"), rows_per_file(i, 10000).alias("url_file"),
                       rows_per_file(i, 1000).alias("range_file"), rows_per_file(i, 25).alias("archive_shard"))


@query("sink_ledger", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents) GROUP BY doc_id")
def sink_ledger(spark, sf_dir):
    path = scratch_path(spark, "ledger")
    W.append_ledger(table(spark, sf_dir, "labels").select("doc_id"), path)
    W.append_ledger(table(spark, sf_dir, "documents").select("doc_id"), path)
    return R.read_parquet(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

