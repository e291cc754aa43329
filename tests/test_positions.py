"""Positions, shards, splits, interleaving: properties and skewed groups."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from captionforge.operators import combine as K, ordering as O, positions as P


def ids(spark, n, partitions=5):
    return spark.range(0, n, 1, partitions).withColumn("key", F.hash("id"))


def test_row_index_is_dense(spark):
    rows = P.with_row_index(ids(spark, 5000), ["key", "id"]).orderBy("key", "id").collect()
    assert [r["row_idx"] for r in rows] == list(range(5000))


def test_row_index_of_empty(spark):
    assert P.with_row_index(ids(spark, 0), ["id"]).count() == 0


def test_group_index_with_a_hot_group_and_nulls(spark):
    group = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 8, F.lit(None)).otherwise((F.col("id") % 13).cast("string"))
    df = ids(spark, 20000).withColumn("g", group)
    placed = P.with_group_index(df, ["g"], ["id"])
    seen = {}
    for r in placed.collect():
        seen.setdefault(r["g"], []).append((r["id"], r["pos"]))
    for rows in seen.values():
        assert [p for _, p in sorted(rows)] == list(range(len(rows)))
    # the hot group is spread over several slices of the sort, not numbered by one task
    slices = P._sorted_slices(df, [F.col("g"), F.col("id")])
    assert slices.where("g = 'hot'").select("__slice").distinct().count() >= 4
    assert slices.groupBy("__slice").count().agg(F.max("count")).first()[0] < 5000


@pytest.mark.parametrize("length, n, sizes", [(10, 1, [10]), (10, 3, [4, 3, 3]), (11, 3, [4, 4, 3]), (53, 7, [8, 8, 8, 8, 7, 7, 7]), (3, 4, [1, 1, 1, 0])])
def test_shards(spark, length, n, sizes):
    rows = sorted((r["id"], r["shard"]) for r in P.shard_contiguous(spark.range(length), ["id"], n).collect())
    shards = [shard for _, shard in rows]
    assert shards == sorted(shards) and [shards.count(i) for i in range(n)] == sizes
    assert [P.shard(spark.range(length), ["id"], n, i).count() for i in range(n)] == sizes


def tied(spark, n=30000):
    """Two thirds of the rows have one key, some none; half of the rows are repeated exactly."""
    key = F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 30 == 0, F.lit(None)).otherwise(F.col("id") % 11).cast("int")
    return spark.range(0, n, 1, 5).select(key.alias("k"), F.floor(F.col("id") / 2).alias("v"))


@pytest.mark.parametrize("n", [0, 10, 10001, 25000, 30000, 40000])
def test_tied_keys_take_and_skip(spark, n):
    df = tied(spark)
    head, rest = P.take(df, ["k"], n), P.skip(df, ["k"], n)
    assert head.count() == min(n, 30000)
    # the two are complementary, also as rows
    assert head.union(rest).groupBy("k", "v").count().exceptAll(df.groupBy("k", "v").count()).count() == 0
    want = sorted((r["k"] is not None, r["k"] or 0) for r in df.collect())[:n]
    assert sorted((r["k"] is not None, r["k"] or 0) for r in head.collect()) == want


def test_tied_keys_slices_and_shards(spark):
    df = tied(spark)
    assert P.getitem(df, ["k"], slice(0, 100)).count() == 100
    assert P.getitem(df, ["k"], slice(14000, 20001)).count() == 6001
    assert P.getitem(df, ["k"], slice(200, 100)).count() == 0
    assert [P.split_by_node(df, ["k"], i, 4).count() for i in range(4)] == [7500] * 4
    same = df.select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    assert [P.shard(same, ["k"], 4, i).count() for i in range(4)] == [7500] * 4


@pytest.mark.parametrize("shuffle", [True, False])
def test_tied_keys_splits(spark, shuffle):
    df = tied(spark)
    split = O.train_test_split(df, ["k"], test_size=0.25, shuffle=shuffle)
    assert Counter(r["split"] for r in split.collect()) == {"train": 22500, "test": 7500}
    assert O.train_test_split(df.limit(0), ["k"], test_size=0.25, shuffle=shuffle).count() == 0
    by_class = O.train_test_split_stratified(df.where("k is not null"), "k", ["v"], test_size=0.25, seed=1)
    assert Counter(r["split"] for r in by_class.collect()) == {"train": 21750, "test": 7250}
    assert O.train_test_split_stratified(df.limit(0), "k", ["v"]).count() == 0


@pytest.mark.parametrize("small, sample", [(10, 50), (400, 100)])
def test_borders_by_narrowing(spark, monkeypatch, small, sample):
    """Intervals are narrowed by samples until few rows are left; two thirds of the rows have one key."""
    monkeypatch.setattr(P, "SMALL", small)
    monkeypatch.setattr(P, "SAMPLE", sample)
    df = tied(spark, 6000).withColumn("w", F.when(F.col("v") % 5 > 0, F.concat(F.lit("k"), F.col("v") % 90))).cache()
    for order in (["k"], ["w", "k"]):
        rows = sorted(((tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in order)) for r in df.collect()))
        wanted = [0, 1, 700, 2999, 5300, 5999]
        total, borders = P.keys_at(df, order, [*wanted, 6000, -1])
        assert total == 6000 and set(borders) == set(wanted)
        for p, b in borders.items():
            key = tuple((b.keys[c] is not None, b.keys[c] if b.keys[c] is not None else 0) for c in order)
            assert key == rows[p] and b.first == rows.index(key) and b.rows == rows.count(key)
    assert P.keys_at(df.limit(0), ["k"], [0]) == (0, {})


def test_positions_read_keys_only(spark, tmp_path):
    spark.range(5000).select("id", F.repeat(F.lit("x"), 50).alias("wide")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for found in (P.skip(df, ["id"], 20), P.take(df, ["id"], 20), P.getitem(df, ["id"], slice(5, 9)), P.split_by_node(df, ["id"], 1, 3),
                  P.shard_contiguous(df, ["id"], 4), O.train_test_split(df, ["id"], test_size=0.2), O.train_test_split_stratified(
                      df.withColumn("c", F.col("id") % 2), "c", ["id"], test_size=0.2)):
        plan = found.select("id")._jdf.queryExecution().executedPlan().toString()
        reads = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
        assert reads and not any("wide" in r for r in reads), plan


def test_getitem_with_negative_steps(spark):
    df = spark.range(10)
    for key in (slice(None, None, -1), slice(8, 2, -3), slice(-2, None, -4), slice(2, 8, -1), slice(None, None, 4)):
        got = [r["id"] for r in P.getitem(df, ["id"], key).collect()]
        assert (got if key.step < 0 else sorted(got)) == list(range(10))[key]


def test_shard_pick(spark):
    assert [r["id"] for r in P.shard(spark.range(10), ["id"], 3, 1).orderBy("id").collect()] == [4, 5, 6]
    assert [r["id"] for r in P.shard(spark.range(10), ["id"], 3, 1, contiguous=False).orderBy("id").collect()] == [1, 4, 7]
    with pytest.raises(ValueError):
        P.shard(spark.range(10), ["id"], 3, 3)


def test_getitem(spark):
    df = spark.range(10)
    assert [r["id"] for r in P.getitem(df, ["id"], [3, -1, 3, 0]).collect()] == [3, 9, 3, 0]
    assert [r["id"] for r in P.getitem(df, ["id"], -2).collect()] == [8]
    assert sorted(r["id"] for r in P.getitem(df, ["id"], slice(-4, None, 2)).collect()) == [6, 8]
    with pytest.raises(Exception, match="out of range"):
        P.getitem(df, ["id"], [10]).collect()
    with pytest.raises(KeyError):
        P.getitem(df, ["id"], "nope")


def test_chunk_ranges(spark):
    full = [(r["start"], r["stop"]) for r in P.chunk_ranges(spark, 2500, 1000).orderBy("start").collect()]
    assert full == [(0, 1000), (1000, 2000), (2000, 2500)]
    lost = [(r["start"], r["stop"]) for r in P.chunk_ranges(spark, 2500, 1000, lose_last_row=True).orderBy("start").collect()]
    assert lost == [(0, 1000), (1000, 2000), (2000, 2499)]


def test_split_sizes():
    assert O.split_sizes(1066, 0.2) == (852, 214)
    assert O.split_sizes(10) == (7, 3)
    assert O.split_sizes(10, train_size=4) == (4, 6)
    for bad in ({"test_size": 0}, {"test_size": 10}, {"test_size": 1.0}, {"test_size": 0.6, "train_size": 0.6},
                {"test_size": 8, "train_size": 5}):
        with pytest.raises(ValueError):
            O.split_sizes(10, **bad)


def test_stratified_split(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 900, "big").otherwise((F.col("id") % 3).cast("string")))
    rows = O.train_test_split_stratified(df, "c", ["id"], test_size=0.25, seed=1).collect()
    assert Counter(r["split"] for r in rows) == {"test": 250, "train": 750}
    by_class = Counter((r["c"], r["split"]) for r in rows)
    assert by_class["big", "test"] == 225 and all(8 <= by_class[c, "test"] <= 9 for c in "012")
    with pytest.raises(ValueError, match="only 1 member"):
        O.train_test_split_stratified(spark.range(5).withColumn("c", F.when(F.col("id") == 0, 1).otherwise(0)), "c", ["id"])


def test_shuffle_is_a_seeded_permutation(spark):
    df = spark.range(2000)
    a = [r["id"] for r in O.shuffle(df, ["id"], 1).collect()]
    b = [r["id"] for r in O.shuffle(df.repartition(3), ["id"], 1).collect()]
    c = [r["id"] for r in O.shuffle(df, ["id"], 2).collect()]
    assert a == b != c and sorted(a) == list(range(2000)) != a


def sources(spark, lengths):
    rows, offset = [], 0
    for s, n in enumerate(lengths):
        rows += [(s, offset + i) for i in range(n)]
        offset += n
    return spark.createDataFrame(rows, "src int, id long")


def order(df):
    return [r["id"] for r in df.orderBy("out_idx").collect()]


def test_interleave_cycles(spark):
    df = sources(spark, [3, 4, 5])
    assert order(K.interleave_cycle(df, "src", ["id"])) == [0, 3, 7, 1, 4, 8, 2, 5, 9]
    assert order(K.interleave_cycle_all(df, "src", ["id"])) == [0, 3, 7, 1, 4, 8, 2, 5, 9, 0, 6, 10, 1, 3, 11]


def test_interleave_all_with_a_tiny_source(spark, monkeypatch):
    monkeypatch.setattr(K, "COPIES_PER_ROW", 7)
    df = sources(spark, [1, 40, 3])
    got = order(K.interleave_cycle_all(df, "src", ["id"]))
    assert got == [x for i in range(40) for x in (0, 1 + i, 41 + i % 3)]


@pytest.mark.parametrize("all_exhausted", [False, True])
def test_interleave_prob(spark, all_exhausted):
    lengths, p = [30, 40, 5], {0: 0.5, 1: 0.3, 2: 0.2}
    out = K.interleave_prob(sources(spark, lengths), "src", ["id"], p, 5, all_exhausted)
    drawn = [(r["src"], r["id"]) for r in out.orderBy("out_idx").collect()]
    # replay the draws with the plain loop
    draws = [r["src"] for r in K.draw_sources(spark, p, 2000, 5, "src").orderBy("step").collect()]
    offsets, at, done, want = [0, 30, 70], [0, 0, 0], [False] * 3, []
    for s in draws:
        if (all if all_exhausted else any)(done):
            break
        want.append((s, offsets[s] + at[s]))
        at[s] += 1
        if at[s] == lengths[s]:
            done[s], at[s] = True, 0
    assert drawn == want


def test_batches(spark):
    rows = P.batch(spark.range(25).withColumn("x", F.col("id") * 2), ["id"], 10).orderBy("batch_id").collect()
    assert [r["id"] for r in rows] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert rows[2]["x"] == [40, 42, 44, 46, 48]
    assert P.batch(spark.range(25), ["id"], 10, drop_last=True).count() == 2


def test_random_sort_flags(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a int, b string")
    got = [r["id"] for r in O.sort(df, ["a", "b", "id"], [True, False, False]).collect()]
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0])
    assert got == [r[0] for r in sorted(rows, key=key)]
    with pytest.raises(ValueError):
        O.sort(df, ["a"], [True, False])


def test_slices_by_key_comparison(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 3]), rng.choice([None, "a", "b"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, i long")
    ordered = [r[2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))]
    got = lambda d: sorted(r["i"] for r in d.collect())
    names = ["a", "b", "i"]
    for start in (0, 1, 30, 77, 150, 199, 200, 500):
        assert got(P.skip(df, names, start)) == sorted(ordered[start:])
        assert got(P.getitem(df, names, slice(start, start + 25))) == sorted(ordered[start:start + 25])
    assert got(P.shard(df, names, 7, 3)) == sorted(ordered[87:116])
    assert got(P.skip(df, [F.col("i").desc()], 150)) == list(range(50))


def test_large_take(spark, monkeypatch):
    assert sorted(r["id"] for r in P.take(spark.range(50), ["id"], 20).collect()) == list(range(20))
    assert P.take(spark.range(50), ["id"], 80).count() == 50


def test_slice_is_pushed_to_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = P.skip(docs, ["doc_id"], 25)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(doc_id),GreaterThanOrEqual(doc_id,25))" in plan or "GreaterThanOrEqual(doc_id,25)" in plan


def test_split_keeps_every_row_once(spark):
    df = spark.range(103).withColumn("k", F.col("id") % 2)
    rows = O.train_test_split(df, ["id"], test_size=0.25, seed=4).collect()
    assert Counter(r["split"] for r in rows) == {"test": 26, "train": 77} and len({r["id"] for r in rows}) == 103
    ordered = O.train_test_split(df, ["id"], test_size=3, train_size=50, shuffle=False)
    assert sorted((r["id"], r["split"]) for r in ordered.collect()) == [(i, "train") for i in range(50)] + [(i, "test") for i in range(50, 53)]
