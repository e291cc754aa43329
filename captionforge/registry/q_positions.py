"""Positional operators, sorting, shuffling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from captionforge.operators import ordering, positions as P
from captionforge.registry import query, sqltext as S, table

_IDX = "row_number() OVER (ORDER BY doc_id) - 1"
_INDEXED = f"SELECT doc_id, lang, {_IDX} AS row_idx FROM documents"
_N = "(SELECT count(*) FROM documents)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


@query("row_index", _INDEXED)
def row_index(spark, sf_dir):
    return P.with_row_index(_docs(spark, sf_dir), ["doc_id"])


def _shard_sql(n: int) -> str:
    div, mod = f"({_N} // {n})", f"({_N} % {n})"
    return (f"SELECT o_orderkey, CAST(CASE WHEN i < m * (d + 1) THEN i // (d + 1) ELSE m + (i - m * (d + 1)) // greatest(d, 1) END AS BIGINT) AS shard "
            f"FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, "
            f"{div.replace('documents', 'orders')} AS d, {mod.replace('documents', 'orders')} AS m FROM orders)")


@query("shard_contiguous", _shard_sql(7))
def shard_contiguous(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return P.shard_contiguous(orders, ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "shard")


@query("shard_strided", f"SELECT doc_id, ({_IDX}) % 6 AS shard FROM documents")
def shard_strided(spark, sf_dir):
    return P.shard_strided(_docs(spark, sf_dir), ["doc_id"], 6).select("doc_id", "shard")


@query("split_by_node", f"SELECT o_orderkey FROM ({_shard_sql(4)}) WHERE shard = 1")
def split_by_node(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return P.split_by_node(orders, ["o_orderdate", "o_orderkey"], 1, 4).select("o_orderkey")


@query("select_indices", f"""WITH d AS ({_INDEXED}), w AS (SELECT event_id AS list_pos, user_id % (2 * {_N}) - {_N} AS want FROM events)
  SELECT list_pos, doc_id, lang FROM w JOIN d ON d.row_idx = CASE WHEN want < 0 THEN want + {_N} ELSE want END""")
def select_indices(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n = docs.count()
    wanted = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("list_pos"), (F.col("user_id") % (2 * n) - n).alias("want"))
    return P.select_indices(docs, ["doc_id"], wanted, "want", "list_pos")


@query("skip", f"SELECT doc_id, lang FROM ({_INDEXED}) WHERE row_idx >= 25")
def skip(spark, sf_dir):
    return P.skip(_docs(spark, sf_dir), ["doc_id"], 25)


@query("take", "SELECT doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")
def take(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return P.take(docs, [F.col("n_chars").desc(), "doc_id"], 40).select("doc_id", "lang")


@query("getitem_slice", f"SELECT doc_id, lang FROM ({_INDEXED}) WHERE row_idx >= 10 AND row_idx < {_N} - 5 AND (row_idx - 10) % 3 = 0")
def getitem_slice(spark, sf_dir):
    return P.getitem(_docs(spark, sf_dir), ["doc_id"], slice(10, -5, 3))


@query("batch", f"""SELECT row_idx // 32 AS batch_id, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
  string_agg(lang, ',' ORDER BY row_idx) AS langs FROM ({_INDEXED}) GROUP BY row_idx // 32""")
def batch(spark, sf_dir):
    batches = P.batch(_docs(spark, sf_dir), ["doc_id"], 32)
    return batches.select("batch_id", F.size("doc_id").cast("long").alias("n_rows"), F.array_min("doc_id").alias("first_doc"),
                          F.array_max("doc_id").alias("last_doc"), F.concat_ws(",", "lang").alias("langs"))


@query("batch_drop_last", f"SELECT row_idx // 32 AS batch_id, string_agg(lang, ',' ORDER BY row_idx) AS langs FROM ({_INDEXED}) GROUP BY row_idx // 32 HAVING count(*) = 32")
def batch_drop_last(spark, sf_dir):
    return P.batch(_docs(spark, sf_dir), ["doc_id"], 32, drop_last=True).select("batch_id", F.concat_ws(",", "lang").alias("langs"))


@query("iter", "SELECT i // 1000 AS batch_id, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY i // 1000")
def iter_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    total = F.aggregate("o_totalprice", F.lit(0.0), lambda a, x: a + x)
    return P.batch(orders, ["o_orderkey"], 1000).select(
        "batch_id", F.size("o_orderkey").cast("long").alias("n_rows"), F.round(total, 2).alias("total"))


@query("sub_batch", "SELECT o_orderkey, i // 840 AS batch_id, (i % 840) // 140 AS piece FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def sub_batch(spark, sf_dir):
    rows = P.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return rows.select("o_orderkey", F.floor(F.col("row_idx") / 840).alias("batch_id"),
                       P.sub_batch(F.col("row_idx") % 840, 140).alias("piece"))


def _ranges(last: str) -> str:
    n = "(SELECT count(*) FROM lineitem)"
    return f"SELECT i AS chunk_id, i * 1000 AS start, least(i * 1000 + 1000, {n}{last}) AS stop FROM range((({n}) + 999) // 1000) r(i)"


@query("chunk_ranges", _ranges(""))
def chunk_ranges(spark, sf_dir):
    return P.chunk_ranges(spark, table(spark, sf_dir, "lineitem").count(), 1000)


@query("chunk_ranges_compat", _ranges(" - 1"))
def chunk_ranges_compat(spark, sf_dir):
    return P.chunk_ranges(spark, table(spark, sf_dir, "lineitem").count(), 1000, lose_last_row=True)


@query("flatten_indices", "SELECT doc_id, source FROM documents WHERE n_chars > 1000")
def flatten_indices(spark, sf_dir):
    picked = table(spark, sf_dir, "documents").where(F.col("n_chars") > 1000).select("doc_id", "source")
    return P.flatten_indices(picked)


# ---- sort, shuffle, split ----

_NULLED = "SELECT doc_id, lang, CASE WHEN n_chars > 300 THEN n_chars END AS size FROM documents"


@query("sort", f"SELECT doc_id, row_number() OVER (ORDER BY size DESC NULLS LAST, lang ASC NULLS LAST, doc_id) - 1 AS sorted_idx FROM ({_NULLED})")
def sort(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") > 300, F.col("n_chars")).alias("size"))
    keys = ordering.sort_columns(["size", "lang", "doc_id"], [True, False, False])
    return P.with_row_index(rows, keys, "sorted_idx").select("doc_id", "sorted_idx")


@query("sort_nulls_first", f"SELECT doc_id, row_number() OVER (ORDER BY size ASC NULLS FIRST, doc_id) - 1 AS sorted_idx FROM ({_NULLED})")
def sort_nulls_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 300, F.col("n_chars")).alias("size"))
    keys = ordering.sort_columns(["size", "doc_id"], null_placement="at_start")
    return P.with_row_index(rows, keys, "sorted_idx").select("doc_id", "sorted_idx")


def _shuffled(seed: int, key: str) -> str:
    return f"row_number() OVER (ORDER BY {S.uniform(seed, key)}, {key}) - 1"


@query("shuffle", f"SELECT o_orderkey, {_shuffled(42, 'o_orderkey')} AS shuffled_idx FROM orders")
def shuffle(spark, sf_dir):
    return ordering.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 42, "shuffled_idx")


@query("train_test_split", f"""SELECT o_orderkey, CASE WHEN i < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT o_orderkey, {_shuffled(7, 'o_orderkey')} AS i, count(*) OVER () AS n FROM orders)""")
def train_test_split(spark, sf_dir):
    return ordering.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], test_size=0.2, seed=7)


@query("train_test_split_ordered", """SELECT doc_id, CASE WHEN i < floor(0.5::DOUBLE * n) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
  WHERE i < floor(0.5::DOUBLE * n) + ceil(0.25::DOUBLE * n)""")
def train_test_split_ordered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return ordering.train_test_split(docs, ["doc_id"], test_size=0.25, train_size=0.5, shuffle=False)


_STRATIFIED = f"""WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
 t AS (SELECT sum(n)::BIGINT AS n, CAST(ceil(0.3::DOUBLE * sum(n)) AS BIGINT) AS k FROM c),
 q AS (SELECT p, c.n AS n, (c.n * t.k) // t.n AS base, (c.n * t.k) % t.n AS rest, t.k AS k FROM c, t),
 r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, p) AS place, k - sum(base) OVER () AS missing FROM q),
 f AS (SELECT p, base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS n_test FROM r),
 o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {S.uniform(3, 'o_orderkey')}, o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN i < n_test THEN 'test' ELSE 'train' END AS split FROM o JOIN f ON o.o_orderpriority = f.p"""


@query("train_test_split_stratified", _STRATIFIED)
def train_test_split_stratified(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ordering.train_test_split_stratified(orders, "o_orderpriority", ["o_orderkey"], test_size=0.3, seed=3)


def _tied_counts(sizes: list[int]) -> str:
    """Keys of the first rows of lineitem by quantity, of which thousands have each value."""
    parts = [f"SELECT {n}::BIGINT AS wanted, l_quantity FROM (SELECT l_quantity FROM lineitem ORDER BY l_quantity LIMIT {n})" for n in sizes]
    return f"SELECT wanted, l_quantity, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


_TIED = [100, 9_000, 25_000]


@query("take_tied", _tied_counts(_TIED))
def take_tied(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_partkey")
    out = None
    for n in _TIED:
        part = P.take(rows, ["l_quantity"], n).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).withColumn("wanted", F.lit(n).cast("long"))
        out = part if out is None else out.union(part)
    return out.select("wanted", "l_quantity", "n")


@query("shard_tied", """SELECT CASE WHEN i < 4 * ((c + 6) // 7) THEN i // ((c + 6) // 7) ELSE 0 END AS shard, count(*) AS n FROM
  (SELECT row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS c FROM lineitem) WHERE i < (c + 6) // 7 GROUP BY ALL""")
def shard_tied(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_partkey")
    return P.shard(rows, ["l_quantity"], 7, 0).agg(F.lit(0).cast("long").alias("shard"), F.count(F.lit(1)).alias("n"))


@query("train_test_split_tied", """SELECT CASE WHEN i < n_test THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM
  (SELECT row_number() OVER () - 1 AS i, ceil(0.2::DOUBLE * count(*) OVER ()) AS n_test FROM lineitem) GROUP BY ALL""")
def train_test_split_tied(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_partkey")
    return ordering.train_test_split(rows, ["l_quantity"], test_size=0.2, seed=5).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
