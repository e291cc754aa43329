"""Written indexes of vectors and texts against searches of everything."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.operators import search, text_index, vector_index as V


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, width)) * 3
    # a third of all vectors around one middle
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 12, n))
    return middles[which] + rng.normal(size=(n, width))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    x = clustered(3000, 12, 1)
    df = frame(spark, x)
    path = str(tmp_path_factory.mktemp("index")) + "/vectors"
    V.write_index(df, path, "id", "v", cells=40)
    return df, x, path


def nearest(rows):
    found = {}
    for r in rows:
        found.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    return {q: sorted(v) for q, v in found.items()}


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
@pytest.mark.parametrize("probes", [1, 6])
def test_exact_search_is_the_search_of_everything(spark, vectors, metric, probes):
    df, _, path = vectors
    asked = df.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    want = nearest(search.knn_search(df, asked, 5, "id", "v", "q", "v", metric).collect())
    got = nearest(V.search_index(spark, path, asked, 5, "q", "v", "id", probes, metric, exact=True).collect())
    assert got == want


def test_recall_of_a_few_cells(spark, vectors):
    df, x, path = vectors
    asked = df.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    got = nearest(V.search_index(spark, path, asked, 10, "q", "v", "id", probes=8).collect())
    hit = 0
    for q, rows in got.items():
        want = np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:10]
        hit += len({i for _, i, _ in rows} & set(want.tolist()))
    assert len(got) == 150 and hit / 1500 >= 0.9


def test_registered_recall(spark, sf_dir):
    from __spark_entry__ import queries

    close = {(r.query_id, r.vec_id) for r in queries()["knn_index"](spark, sf_dir).collect()}
    exact = {(r.query_id, r.vec_id) for r in queries()["knn_index_exact"](spark, sf_dir).collect()}
    assert len(close & exact) >= 0.9 * len(exact)


def test_every_vector_is_in_one_cell_and_only_probed_cells_are_read(spark, vectors):
    df, x, path = vectors
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = [r.id for r in blocks.select(F.explode("keys").alias("id")).collect()]
    assert sorted(ids) == list(range(3000))
    assert blocks.agg(F.max(F.size("keys"))).first()[0] <= V.BLOCK
    one = df.where("id = 7").select(F.col("id").alias("q"), "v")
    found = V.search_index(spark, path, one, 3, "q", "v", "id", probes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    cells = os.listdir(f"{path}/blocks")
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(cells) > 30


def test_hot_cells_are_split_and_queries_come_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(V, "BLOCK", 32)
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    x = np.concatenate([np.zeros((800, 3)), clustered(300, 3, 2)])  # ties: 800 equal vectors
    df = frame(spark, x)
    V.write_index(df, f"{tmp_path}/i", "id", "v", cells=5)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    got = nearest(V.search_index(spark, f"{tmp_path}/i", asked, 4, "q", "v", "id", probes=1, exact=True).collect())
    assert got == nearest(search.knn_search(df, asked, 4, "id", "v", "q", "v").collect())


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [nan, 1.0]), ("c", None), ("d", [inf, 0.0]), ("e", [3.0, 1.0])], "id string, v array<float>")
    V.write_index(df, f"{tmp_path}/i", "id", "v", cells=64)
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [nan, 0.0]), (3, None)], "q int, w array<double>")
    rows = V.search_index(spark, f"{tmp_path}/i", asked, 5, "q", "w", exact=True).collect()
    assert [(r.q, r.id, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, "a", 1), (1, "e", 2)]
    V.write_index(df.limit(0), f"{tmp_path}/none", "id", "v")
    assert V.search_index(spark, f"{tmp_path}/none", asked, 5, "q", "w").count() == 0
    assert V.search_index(spark, f"{tmp_path}/i", asked.limit(0), 5, "q", "w", exact=True).count() == 0
    with pytest.raises(ValueError):
        V.search_index(spark, f"{tmp_path}/i", asked, 5, "q", "w", metric="cosine")
    with pytest.raises(ValueError):
        V.fit_centres(df, "id", "v", 10**8)


# ---- texts ----

def corpus(rng, n, vocabulary=300):
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(n)]


def ranked(rows):
    return sorted((r["q"], r["rank"], r["d"], r["score"]) for r in rows)


def plain_bm25(spark, df, asked, k, tmp):
    """Every document scored, in plain Python."""
    import math
    import re
    from collections import Counter

    rows = [(r.d, Counter(re.findall(r"\w+", r.t.lower()))) for r in df.collect() if r.t is not None]
    n = df.count()
    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    have = Counter(t for _, c in rows for t in c)
    out = []
    for r in asked.collect():
        scored = []
        for d, c in rows:
            s = 0.0
            for t in set(re.findall(r"\w+", (r.w or "").lower())):
                if c[t]:
                    s += math.log(1 + (n - have[t] + 0.5) / (have[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if s:
                scored.append((-round(s, 6), d))
        out += [(r.q, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, block, aside", [(3, 4096, 0.5), (10, 7, 0.9), (1, 50, 0.0), (1000, 7, 0.5)])
def test_text_index_gives_the_same_as_scoring_everything(spark, tmp_path, monkeypatch, k, block, aside):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", block)
    monkeypatch.setattr(text_index, "ASIDE", aside)
    monkeypatch.setattr(text_index, "SEEDS", 20)
    rng = random.Random(k)
    texts = corpus(rng, 250) + [None, "", "!!", "w0 " * 40, "été w1", "W2 w2"]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(corpus(rng, 25) + [None, "", "nowhere", "ÉTÉ", texts[5]])), "q long, w string")
    path = f"{tmp_path}/i"
    text_index.write_text_index(df, path, "d", "t")
    got = ranked(text_index.search_text_index(spark, path, asked, k, "q", "w", "d").collect())
    want = plain_bm25(spark, df, asked, k, tmp_path)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    assert spark.read.parquet(f"{path}/postings").agg(F.max(F.size("docs"))).first()[0] <= max(block, 3 * block)


def test_empty_text_index(spark, tmp_path):
    none = spark.createDataFrame([], "d long, t string")
    text_index.write_text_index(none, f"{tmp_path}/i", "d", "t")
    asked = spark.createDataFrame([(1, "word")], "q long, w string")
    assert text_index.search_text_index(spark, f"{tmp_path}/i", asked, 3, "q", "w", "d").count() == 0
