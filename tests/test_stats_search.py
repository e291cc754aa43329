"""Statistics and search against numpy and plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.operators import search, stats as A


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        label = 0 if i % 3 else (None if i % 5 == 0 else i % 4)  # two thirds in one class, some unlabelled
        rows.append((i, label, (rng.normal(size=6) * (1 + (label or 0)) + 100).tolist()))
    return spark.createDataFrame(rows, "id long, label int, v array<double>"), rows


@pytest.mark.parametrize("per_chunk, held_bytes", [(65536, 0), (50, 0), (7, 0), (65536, 64 << 20)])
def test_class_stats_match_numpy(spark, vectors, per_chunk, held_bytes):
    """Vectors dealt by class in chunks, and sums filled where the vectors are read."""
    df, rows = vectors
    found = {r["label"]: r for r in A.class_stats(df, "label", "v", ["id"], per_chunk, held_bytes).collect()}
    assert set(found) == {r[1] for r in rows}
    for label, r in found.items():
        x = np.array([v for _, l, v in rows if l == label])
        assert r["n"] == len(x)
        np.testing.assert_allclose(r["mu"], x.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(np.array(r["sigma"]), np.cov(x.T), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("held", [1 << 22, 3])
def test_class_means_of_uneven_vectors(spark, monkeypatch, held):
    monkeypatch.setattr(A, "HELD_SUMS", held)
    rows = [(1, [1.0, 2.0]), (1, [3.0]), (1, None), (None, [5.0, None, 7.0]), (2, []), (1, [5.0, 4.0, 9.0]), (None, [1.0, 8.0])] * 3
    df = spark.createDataFrame(rows, "label int, v array<double>").repartition(3)
    got = {(r["label"], r["i"]): (r["n"], r["mean"]) for r in A.class_mean(df, "label", "v").collect()}
    assert got == {(1, 0): (9, 3.0), (1, 1): (6, 3.0), (1, 2): (3, 9.0), (None, 0): (6, 3.0), (None, 1): (3, 8.0), (None, 2): (3, 7.0)}


def test_moments_exchange_sums_only(spark, vectors):
    df, _ = vectors
    plan = A.class_moments(df, "label", "v", ["id"], [100.0] * 6)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Exchange" in line]
    assert scans and all("i#" in line for line in scans)  # by matrix row: none by class or chunk


def test_covariance_of_one_vector_is_null(spark):
    one = spark.createDataFrame([(1, 1, [1.0, 2.0])], "id long, label int, v array<double>")
    assert A.class_stats(one, "label", "v", ["id"]).first()["sigma"] == [[None, None], [None, None]]


def test_frechet_properties(spark, vectors):
    df, rows = vectors
    df = df.where("label is not null")
    s = A.class_stats(df, "label", "v", ["id"])
    moved = A.class_stats(df.withColumn("v", F.transform("v", lambda x: x + 2)), "label", "v", ["id"])
    assert all(abs(r["distance"]) < 1e-6 for r in A.frechet_distance(s, s, "label").collect())
    assert all(abs(r["distance"] - 6 * 4) < 1e-6 for r in A.frechet_distance(s, moved, "label").collect())
    ab = {r["label"]: r["distance"] for r in A.frechet_distance(s, moved, "label").collect()}
    ba = {r["label"]: r["distance"] for r in A.frechet_distance(moved, s, "label").collect()}
    assert all(abs(ab[k] - ba[k]) < 1e-6 for k in ab)


@pytest.mark.parametrize("width, every", [(4, 1), (16, 1), (256, 3)])
def test_ema_matches_the_loop(spark, width, every):
    rng = np.random.default_rng(2)
    rows = [(("hot" if i % 10 else None), i, float(x)) for i, x in enumerate(rng.normal(size=1500))]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    got = {(r["k"], r["pos"]): r["ema"] for r in A.ema_series(df, ["k"], ["t"], "x", 0.9, every, width).collect()}
    want = {}
    for k in ("hot", None):
        e = None
        for pos, x in enumerate([x for kk, _, x in rows if kk == k][::every]):
            e = x if e is None else 0.9 * e + 0.1 * x
            want[k, pos] = e
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
@pytest.mark.parametrize("block_bytes", [32 << 20, 8 * 6 * 4])
def test_knn_matches_brute_force(spark, vectors, metric, block_bytes, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", block_bytes)
    df, rows = vectors
    queries = df.where("id % 90 = 7").select(F.col("id").alias("q"), F.col("v").alias("w"))
    found = search.knn_search(df.repartition(5), queries, 4, "id", "v", "q", "w", metric).collect()
    by_id = {i: np.array(v) for i, _, v in rows}
    for q in {r["q"] for r in found}:
        sign = 1 if metric == "l2" else -1
        dist = {i: np.linalg.norm(v - by_id[q]) if metric == "l2" else float(v @ by_id[q]) for i, v in by_id.items()}
        want = sorted(dist, key=lambda i: (sign * dist[i], i))[:4]
        assert [r["id"] for r in sorted((r for r in found if r["q"] == q), key=lambda r: r["rank"])] == want
    assert len(found) == 4 * queries.count()


def test_knn_with_fewer_rows_than_k(spark, vectors):
    df, _ = vectors
    few, queries = df.where("id < 3"), df.where("id < 2").select(F.col("id").alias("q"), "v")
    assert search.knn_search(few, queries, 10, "id", "v", "q", "v").count() == 6
    assert search.knn_search(few, queries.limit(0), 10, "id", "v", "q", "v").count() == 0


def test_text_search_matches_bm25(spark):
    docs = ["a cat sat", "The cat, the CAT!", "dogs & cats", "", "été à la plage", "cat " * 50, "sat sat dog"]
    asked = ["cat sat", "ÉTÉ", "zebra", "the the dog"]
    df = spark.createDataFrame(list(enumerate(docs)), "d long, t string").repartition(3)
    qf = spark.createDataFrame(list(enumerate(asked)), "q long, w string")
    got = {(r["q"], r["d"]): (r["score"], r["rank"]) for r in search.text_search(df, qf, 3, "d", "t", "q", "w").collect()}
    toks = [re.findall(r"\w+", t.lower()) for t in docs]
    mean = sum(map(len, toks)) / len(toks)
    want = {}
    for q, text in enumerate(asked):
        scores = []
        for d, tk in enumerate(toks):
            counts, s = Counter(tk), 0.0
            for term in set(re.findall(r"\w+", text.lower())):
                n = sum(term in x for x in toks)
                if counts[term]:
                    idf = math.log(1 + (len(toks) - n + 0.5) / (n + 0.5))
                    s += idf * counts[term] * 2.2 / (counts[term] + 1.2 * (0.25 + 0.75 * len(tk) / mean))
            if s:
                scores.append((-round(s, 6), d))
        for rank, (s, d) in enumerate(sorted(scores)[:3], 1):
            want[q, d] = (-s, rank)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_vectors_that_are_not_finite_hide_no_neighbour(spark):
    from captionforge.operators import search

    nan, inf = float("nan"), float("inf")
    base = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [nan, 0.0]), (3, [2.0, 0.0]), (4, [5.0, 5.0]), (5, [inf, 0.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, [nan, 0.0])], "q long, w array<double>")
    for metric, want in (("l2", [0, 1, 3, 4]), ("inner_product", [0, 1, 3, 4])):
        rows = search.knn_search(base, asked, 6, "id", "v", "q", "w", metric).collect()
        assert sorted(r["id"] for r in rows) == want and {r["q"] for r in rows} == {7}
