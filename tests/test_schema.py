"""Schema operators, filters and lookups: quirks and error cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.operators import filters, lookups as L, schema as S
from captionforge.operators.combine import add_item, concat_rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "b", None), (2, "a", True), (3, None, False)], "id long, name string, flag boolean")


def test_unknown_columns_are_errors(df):
    for call in (lambda: S.remove_columns(df, ["x"]), lambda: S.select_columns(df, ["x"]),
                 lambda: S.rename_columns(df, {"x": "y"}), lambda: S.cast_column(df, "x", "int"),
                 lambda: S.rename_columns(df, {"id": "name"})):
        with pytest.raises(ValueError):
            call()


def test_rename_keeps_position(df):
    assert S.rename_columns(df, {"name": "title"}).columns == ["id", "title", "flag"]


def test_cast_needs_equal_columns_and_good_values(spark, df):
    with pytest.raises(ValueError):
        S.cast(df, T.StructType([T.StructField("id", T.LongType())]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.cast_column(df, "name", "int").collect()


def test_class_encode(df):
    coded, names = S.class_encode(df, "name")
    assert {r["id"]: r["name"] for r in coded.collect()} == {1: 1, 2: 0, 3: None}
    assert {r["class_id"]: r["class_name"] for r in names.collect()} == {0: "a", 1: "b"}
    coded, names = S.class_encode(df, "flag", include_nulls=True)
    assert [r["class_name"] for r in names.orderBy("class_id").collect()] == ["False", "None", "True"]
    assert {r["id"]: r["flag"] for r in coded.collect()} == {1: 1, 2: 2, 3: 0}


def test_numbers_are_encoded_as_text(spark):
    coded, _ = S.class_encode(spark.createDataFrame([(10,), (9,)], "x int"), "x")
    assert sorted(r["x"] for r in coded.collect()) == [0, 1]
    names = S.class_encode(spark.createDataFrame([(10,), (9,)], "x int"), "x")[1]
    assert [r["class_name"] for r in names.orderBy("class_id").collect()] == ["10", "9"]


def test_align_labels(spark):
    df = spark.createDataFrame([(0, [0, 1]), (1, None), (None, [1])], "y int, ys array<int>")
    out = S.align_labels(S.align_labels(df, "y", ["Cat", "DOG"], {"dog": 7, "cat": 8}), "ys", ["Cat", "DOG"], {"dog": 7, "cat": 8})
    assert [tuple(r) for r in out.collect()] == [(8, [8, 7]), (7, None), (None, [7])]
    with pytest.raises(Exception, match="no aligned label"):
        S.align_labels(df, "y", ["cat", "cow"], {"cat": 1}).collect()


def test_flatten(spark):
    df = spark.sql("select 1 as a, named_struct('b', 2, 'c', named_struct('d', 3)) as s")
    assert S.flatten(df).columns == ["a", "s.b", "s.c.d"]
    assert tuple(S.flatten(df).first()) == (1, 2, 3)


def test_concat_and_add_item(spark, df):
    both = concat_rows([df, spark.createDataFrame([(9, 1.5)], "id long, extra double")])
    assert both.columns == ["id", "name", "flag", "source_no", "extra"] and both.count() == 4
    last = add_item(df, {"id": 7, "name": "z"}).where("id = 7").first()
    assert (last["name"], last["flag"]) == ("z", None)


def test_filters(spark, df):
    assert filters.filter_rows(df, F.col("flag")).count() == 1  # null and false drop
    assert [r["id"] for r in filters.filter_with_index(df, ["id"], lambda i: i > 0).orderBy("id").collect()] == [2, 3]
    rows = spark.createDataFrame([("f", i) for i in range(9)] + [("g", i) for i in range(10)], "file string, i int")
    assert [r["file"] for r in filters.surviving_files(rows, "file", 10).collect()] == ["g"]
    with pytest.raises(Exception, match="no captions were generated for f"):
        filters.require_rows_per_file(rows, "file").collect()


def test_quality_report(spark):
    rows = spark.createDataFrame([("f", 1), ("f", 5), ("g", 5)], "file string, i int")
    report = {r["file"]: r for r in filters.quality_report(rows, "file", F.col("i") > 2).collect()}
    assert (report["f"]["n_kept"], report["f"]["pct_dropped"]) == (1, 50.0)
    assert (report[None]["n_in"], report[None]["n_dropped"]) == (3, 1)
    empty = filters.quality_report(rows.where("i > 9"), "file", F.col("i") > 2).collect()
    assert [r["pct_dropped"] for r in empty] == [None]


def test_keep_not_null(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    kept = filters.keep_not_null(df, "j", F.when(F.col("i") != 2, F.col("i") * 10))
    assert [tuple(r) for r in kept.orderBy("i").collect()] == [(1, 10), (3, 30)]


def talk(*values):
    return [{"from": "human", "value": v} for v in values]


def test_join_recaption(spark):
    rows = spark.createDataFrame(
        [("1", talk("q", " alt 1 ")), ("2", talk("q", "alt 2")), ("3", talk("q", " alt 3 ")), ("4", talk("only"))],
        "id string, conversations array<struct<from: string, value: string>>")
    side = spark.createDataFrame(
        [(0, "1", "old long", "old short"), (1, "1", " new long ", "new short"), (2, "2", "long 2", None), (3, "5", "x", "y")],
        "n long, key string, caption_llava string, caption_llava_short string")
    got = {r["id"]: (r["recaption"], r["recaption_short"], r["missed"]) for r in L.join_recaption(rows, side, "n").collect()}
    assert got == {"1": ("new short", "new long", False), "2": ("alt 2", "long 2", True), "3": ("alt 3", "alt 3", True),
                   "4": (None, None, True)}
    straight = {r["id"]: (r["recaption"], r["recaption_short"]) for r in L.join_recaption(rows, side, "n", crossed=False).collect()}
    assert straight["1"] == ("new long", "new short") and straight["2"] == ("long 2", "long 2")
    assert sorted(r["id"] for r in L.join_recaption_misses(rows, side).collect()) == ["3", "4"]


def test_zip_and_add_column(spark, df):
    other = spark.createDataFrame([(i, i * 10) for i in (3, 1, 2)], "k int, v int")
    out = L.zip_columns(df, ["id"], other, ["k"])
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, 10), (2, 20), (3, 30)]
    with pytest.raises(ValueError, match="duplicate"):
        L.zip_columns(df, ["id"], df, ["id"])
    with pytest.raises(ValueError, match="row counts"):
        L.zip_columns(df, ["id"], other.limit(2), ["k"])
    assert sorted((r["id"], r["w"]) for r in L.add_column(df, ["id"], "w", other, ["k"]).collect()) == [(1, 10), (2, 20), (3, 30)]
    with pytest.raises(ValueError, match="exists"):
        L.add_column(df, ["id"], "name", other, ["k"])


def test_merge_captions(spark):
    from captionforge.plans.training_set import merge_captions

    raw = spark.createDataFrame(
        [("1", (bytearray(b"a"), "p"), talk("q", "alt")), ("2", (bytearray(b"b"), "p"), talk("q", " alt 2 "))],
        "id string, image struct<bytes: binary, path: string>, conversations array<struct<from: string, value: string>>")
    side = spark.createDataFrame([(0, "1", "long", "short")], "n long, key string, caption_llava string, caption_llava_short string")
    rows, missed = merge_captions(raw, side, "n")
    assert rows.columns == ["id", "image", "recaption", "recaption_short", "class"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", b"a", "short", "long", "CC12M"), ("2", b"b", "alt 2", "alt 2", "CC12M")]
    assert [r["id"] for r in missed.collect()] == ["2"]


def test_flatten_has_no_depth_limit(spark):
    kind = "int"
    for i in range(20):
        kind = f"struct<f{i}:{kind}>"
    df = spark.createDataFrame([], f"id int, s {kind}, t struct<a:int,b:struct<c:string>>")
    flat = S.flatten(df)
    assert flat.columns == ["id", "s." + ".".join(f"f{i}" for i in reversed(range(20))), "t.a", "t.b.c"]
    assert not any("struct" in t for _, t in flat.dtypes)
