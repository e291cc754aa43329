"""What a task, the driver or a shuffle holds does not grow with the table."""

import glob
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from captionforge.operators import search, text_index, vector_index as V
from captionforge.registry import q_sources
from captionforge.session import scratch_root
from captionforge.sources import archives


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_table_has_a_file_per_reading_task(spark, tmp_path):
    for i in range(7):
        rows = spark.range(20).select(F.lit(i).cast("long").alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), F.lit(1.5).alias("l_quantity"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    before = set(glob.glob(f"{scratch_root(spark).removeprefix('file:')}/parquet-*"))
    assert q_sources.src_parquet(spark, str(tmp_path)).count() == 140
    (path,) = set(glob.glob(f"{scratch_root(spark).removeprefix('file:')}/parquet-*")) - before
    assert len(glob.glob(f"{path}/*.parquet")) == 7


def test_a_task_holds_few_archives(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"archive": ["a"], "member": [str(len(batch))], "content": [b""], "error": [None]})

    monkeypatch.setattr(archives, "_unpack", sizes)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    rows = spark.range(6).coalesce(1).select(F.col("id").cast("string").alias("path"), F.encode(F.repeat(F.lit("x"), 3 << 20), "UTF-8").alias("content"))
    held = [int(r.member) for r in archives.tar_members(rows).collect()]
    assert sum(held) == 6 and max(held) <= 3


def test_equal_vectors_give_k_rows_a_query():
    x, q = np.ones((1000, 4)), np.ones((3, 4))
    for metric in ("l2", "inner_product"):
        qi, xi, score = V._pair_best(x, q, 5, metric)
        assert qi.tolist() == [0] * 5 + [1] * 5 + [2] * 5 and xi.tolist() == [0, 1, 2, 3, 4] * 3
        assert set(score.tolist()) == ({0.0} if metric == "l2" else {4.0})


def test_queries_are_passed_on_in_small_pieces(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "id long, v array<double>").repartition(2)
    V.write_index(df, f"{tmp_path}/i", "id", "v", cells=8)
    asked = df.select(F.col("id").alias("q"), "v")
    monkeypatch.setattr(V, "VISIT_BYTES", 1000)
    rows = lambda found: sorted((r["q"], r["rank"], r["id"], r["score"]) for r in found.collect())
    for metric in ("l2", "inner_product"):
        got = V.search_index(spark, f"{tmp_path}/i", asked, 3, "q", "v", "id", 2, metric, exact=True)
        assert rows(got) == rows(search.knn_search(df, asked, 3, "id", "v", "q", "v", metric))


def test_an_index_does_not_pass_through_the_driver(spark, tmp_path):
    df = spark.range(200).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    V.write_index(df, f"{tmp_path}/i", "id", "v", cells=4)
    plan = plan_of(V.search_index(spark, f"{tmp_path}/i", df.select(F.col("id").alias("q"), "v"), 3, "q", "v", "id", 2))
    # other joins with cells are those of the queries with their counts
    assert plan.count("SortMergeJoin [cell") == 1


def test_pairs_of_documents_and_queries_are_not_shuffled(spark, monkeypatch):
    docs = ["a cat sat", "The cat, the CAT!", "dogs & cats", "", None, "cat " * 50, "sat sat dog", "sat sat dog", "a cat"]
    ids = [0, 1, 2, 3, 4, 5, 6, 6, None]
    df = spark.createDataFrame(list(zip(ids, docs)), "d long, t string").repartition(3)
    asked = [(1, "cat sat"), (2, "the the dog"), (None, "dog"), (3, "zebra"), (4, "dogs a")]
    qf = spark.createDataFrame(asked, "q long, w string")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    # rows of one id are one document, whose counts are added
    counts, mean = {}, sum(len(words(t)) for t in docs) / 8
    for d, t in zip(ids, docs):
        counts.setdefault(d, Counter()).update(words(t))
    sizes = {d: len(words(t)) for d, t in zip(ids, docs)}
    want = set()
    for q, text in asked:
        scores = []
        for d, held in counts.items():
            met = [(held[t], sum(t in x for x in counts.values())) for t in set(words(text)) if held[t]]
            score = sum(np.log(1 + (9 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[d] / mean)) for tf, n in met)
            scores += [(-round(score, 6), -1 if d is None else d)] if met else []
        want |= {(q, None if d < 0 else d, rank, -s) for rank, (s, d) in enumerate(sorted(scores)[:2], 1)}
    found = search.text_search(df, qf, 2, "d", "t", "q", "w")
    assert "HashAggregate" not in plan_of(found).split("MapInArrow")[0]
    got = lambda found: {(r["q"], r["d"], r["rank"], round(r["score"], 6)) for r in found.collect()}
    assert got(found) == want
    for block in (8 * 2 * 2, 8):
        monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", block)
        assert got(search.text_search(df, qf, 2, "d", "t", "q", "w")) == want


def test_a_written_index_deals_no_pair_of_document_and_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 16)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.5, size=30) % 200) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(3)
    asked = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts[::10])], "q long, w string")
    text_index.write_text_index(df, f"{tmp_path}/i", "d", "t")
    rows = lambda found: sorted(map(str, found.select("q", "rank", "d").collect()))
    want = rows(search.text_search(df, asked, 4, "d", "t", "q", "w"))
    assert len(want) == 80 and rows(text_index.search_text_index(spark, f"{tmp_path}/i", asked, 4, "q", "w", "d")) == want
    # a document's postings are in one shard, so one task sums them
    postings = spark.read.parquet(f"{tmp_path}/i/postings").select("shard", F.explode("docs").alias("d"))
    assert postings.groupBy("d").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert postings.select("shard").distinct().count() > 5
    monkeypatch.setattr(text_index, "QUERY_BLOCK_BYTES", 8 * 40 * 40)
    assert rows(text_index.search_text_index(spark, f"{tmp_path}/i", asked, 4, "q", "w", "d")) == want
