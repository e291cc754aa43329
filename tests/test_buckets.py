"""Bucket index and batch plan properties."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from captionforge.operators import buckets as B


def rows(spark, n=4000):
    # one bucket holds well over a third of all rows; "9x9" is too small to keep
    bucket = F.when(F.col("id") % 10 < 5, "64x64").when(F.col("id") % 10 < 8, "64x128").when(
        F.col("id") < 20, "9x9").otherwise("128x128")
    return spark.range(n).select(F.col("id").alias("row_idx"), bucket.alias("bucket_size"))


def test_index(spark):
    groups = defaultdict(list)
    for r in B.bucket_index(rows(spark)).collect():
        groups[r["bucket_size"]].append((r["bucket_pos"], r["row_idx"]))
    for members in groups.values():
        members.sort()
        assert [p for p, _ in members] == list(range(len(members)))
        assert [i for _, i in members] == sorted(i for _, i in members)


def test_batches_have_distinct_rows_of_one_bucket(spark):
    truth = {r["row_idx"]: r["bucket_size"] for r in rows(spark).collect()}
    batches = defaultdict(list)
    for r in B.bucket_batches(rows(spark), 8, seed=1, n_batches=600).collect():
        assert truth[r["row_idx"]] == r["bucket_size"]
        batches[r["batch_id"]].append(r)
    assert len(batches) == 600
    for members in batches.values():
        assert len({m["row_idx"] for m in members}) == 8 and len({m["bucket_size"] for m in members}) == 1
        assert sorted(m["pos_in_batch"] for m in members) == list(range(8))
    drawn = Counter(m[0]["bucket_size"] for m in batches.values())
    assert "9x9" not in drawn
    assert abs(drawn["64x64"] / 600 - 0.5) < 0.08 and abs(drawn["64x128"] / 600 - 0.3) < 0.08


def test_places_are_a_uniform_sample(spark):
    """Distinct places, no more neighbours than chance gives, and every place equally often; also where 10007 or 10037 rows are."""
    size, batches = 16, 400
    for n in (48, 10007, 10008, 10036, 10038, 10062, 10007 * 10009):
        stats = spark.createDataFrame([("a", n)], "bucket_size string, n long")
        draws = spark.range(batches).select(F.col("id").alias("batch_id"), F.lit("a").alias("bucket_size"))
        places = defaultdict(list)
        for r in B.batch_positions(draws, stats, size, 4).collect():
            places[r["batch_id"]].append(r["bucket_pos"])
        assert all(len(set(p)) == size and 0 <= min(p) and max(p) < n for p in places.values()) and len(places) == batches
        neighbours = sum(b - a == 1 for p in places.values() for a, b in zip(sorted(p), sorted(p)[1:]))
        chance = batches * (size - 1) * size / n
        assert abs(neighbours - chance) < 6 + 5 * chance**0.5
        middle = sum(p >= n // 2 for x in places.values() for p in x) / (size * batches)
        assert abs(middle - 0.5) < 0.03


def test_a_bucket_smaller_than_a_batch_raises(spark):
    stats = spark.createDataFrame([("a", 3)], "bucket_size string, n long")
    draws = spark.range(1).select(F.col("id").alias("batch_id"), F.lit("a").alias("bucket_size"))
    with pytest.raises(Exception, match="fewer rows"):
        B.batch_positions(draws, stats, 4, 1).collect()


def test_first_batches_from_the_largest_shape(spark):
    plan = B.bucket_batches(rows(spark), 8, seed=1, n_batches=20, first_n=3)
    assert plan.where("batch_id < 3").select("bucket_size").distinct().collect()[0][0] == "128x128"


def test_draw_guide_covers_uneven_buckets(spark):
    sizes = [("b%03d" % i, 1 + (i * i) % 50) for i in range(120)] + [("hot", 3000)]
    stats = spark.createDataFrame(sizes, "bucket_size string, n long")
    drawn = B.draw_buckets(stats, 5000, 9)
    counts = {r["bucket_size"]: r["count"] for r in drawn.groupBy("bucket_size").count().collect()}
    total = sum(n for _, n in sizes)
    assert sum(counts.values()) == 5000
    assert abs(counts["hot"] / 5000 - 3000 / total) < 0.03


def test_max_shape_that_is_no_bucket(spark):
    stats = spark.createDataFrame([("64x128", 5), ("128x64", 5)], "bucket_size string, n long")
    assert tuple(B.bucket_max_shape(stats).first()) == (128, 128, "128x128", None)


def test_no_kept_bucket_gives_no_batches(spark):
    assert B.bucket_batches(rows(spark, 10), 8, seed=1).count() == 0
