"""Model jobs, fetching, sources, sinks, archives and streams on real files."""

import io
import json
import random
import struct
import tarfile
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from captionforge.operators import mapping as M, models
from captionforge.plans import publish
from captionforge.sinks import writers as W
from captionforge.sources import archives, readers as R
from captionforge.streaming import streams


def test_recaption_drops_rejected_rows_and_stays_aligned(spark):
    rows = [(i, b"x", "no " * 9 if i % 4 == 0 else f"In this scene, Dog number {i} runs") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, image binary, alt string").repartition(7)
    done = models.recaption(df, "alt", "image", models.echo_prompt("The image shows "), models.echo_prompt("S: ")).collect()
    assert sorted(r["id"] for r in done) == [i for i in range(200) if i % 4]
    for r in done:
        assert r["recaption"] == f"Dog number {r['id']} runs"
        assert r["recaption_short"] == "S: " + r["recaption"]


def test_encode_text(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, None)], "id int, text string")
    rows = models.encode_text(df, "text", models.hashed_words(12), models.hashed_words(5), models.hashed_words(3)).orderBy("id").collect()
    assert [len(r["text_states"]) for r in rows] == [24, 24] and len(rows[0]["text_pooled"]) == 3
    first = rows[0]["text_states"]
    assert abs(np.linalg.norm(first[:12]) - 1) < 1e-9 and abs(np.linalg.norm(first[12:17]) - 1) < 1e-9 and set(first[17:]) == {0.0}
    assert set(rows[1]["text_states"]) == {0.0}


def test_fetch_retries(spark):
    def fetcher():
        def get(url, attempt):
            if url == "gone":
                return 403, None
            if url == "flaky":
                return (200, b"ok") if attempt == 6 else (500, None)
            if url == "down":
                raise OSError
            if url == "dead":
                return 500, None
            return 200, url.encode()
        return get

    df = spark.createDataFrame([(u,) for u in ["a", "gone", "flaky", "down", "dead"]], "url string")
    fetched = models.fetch(df, "url", fetcher)
    got = {r["url"]: (bytes(r["content"]) if r["content"] else None, r["status"], r["attempts"]) for r in fetched.collect()}
    assert got == {"a": (b"a", 200, 1), "gone": (None, 403, 1), "flaky": (b"ok", 200, 7), "down": (None, None, 7), "dead": (None, 500, 7)}
    good, failed = models.split_fetched(fetched, "url")
    assert good.count() == 2 and sorted(r["url"] for r in failed.collect()) == ["dead", "down", "gone"]


def test_resize_drops_what_the_codec_rejects(spark):
    def codec():
        return lambda b: pd.Series([None if h == 64 else b"%dx%d" % (h, w) for h, w in zip(b["height"], b["width"])])

    df = spark.createDataFrame([(63, 100, b"i"), (2048, 1024, b"i"), (3, 100, b"i")], "h int, w int, image binary")
    assert [tuple(r) for r in models.resize_images(df, "h", "w", "image", codec).select("height", "width", "image").collect()] == [
        (1024, 512, bytearray(b"1024x512"))]


def test_map_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert [tuple(r) for r in M.map_rows(df, lambda r: None).orderBy("id").collect()] == [(1, "a"), (2, "b")]
    out = M.map_rows(df, lambda r: {"n": r["id"] * 2}, "n long", remove_columns=["t"], input_columns=["id"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 2), (2, 4)]


def test_map_exact_batches(spark):
    out = M.map_exact_batches(spark.range(25).repartition(4), ["id"], lambda b: pd.DataFrame({"ids": [b["id"].tolist()]}),
                              "ids array<long>", 10)
    assert sorted(r["ids"] for r in out.collect()) == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_cached_map_runs_once(spark, tmp_path):
    df = spark.range(3)
    first = M.cached_map(df, lambda d: d.withColumn("x", F.lit(1)), str(tmp_path), "v1")
    again = M.cached_map(df, lambda d: d.withColumn("x", F.lit(2)), str(tmp_path), "v1")
    other = M.cached_map(df, lambda d: d.withColumn("x", F.lit(2)), str(tmp_path), "v2")
    assert [d.agg(F.sum("x")).first()[0] for d in (first, again, other)] == [3, 3, 6]


def png(width, height):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height)


def make_tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


@pytest.fixture()
def archive_dir(tmp_path):
    folder = tmp_path / "archives"
    folder.mkdir()
    for a in range(3):
        members = []
        for i in range(80):
            status = "success" if i % 4 else "failed"
            meta = {"key": f"{a}_{i:03d}", "caption": f"c{i}", "url": "u", "status": status, "similarity": 0.5}
            members.append((f"{a}_{i:03d}.png", png(i + 1, 5)))
            if i % 10:
                members.append((f"{a}_{i:03d}.json", b"{broken" if i == 21 else json.dumps(meta).encode()))
        make_tar(folder / f"{a}.tar", members)
    (folder / "bad.tar").write_bytes(b"this is no archive" * 100)
    return folder


def test_archives(spark, archive_dir, tmp_path):
    members = archives.read_archives(spark, str(archive_dir))
    rows = members.select("archive", "member", "ext", "error").collect()
    assert Counter(r["ext"] for r in rows if r["error"] is None) == {"png": 240, "json": 216}
    assert len([r for r in rows if r["error"]]) == 1
    manifest = publish.shard_archives(spark, str(archive_dir), str(tmp_path / "out"), max_shard_size=4000)
    good = [i for i in range(80) if i % 4 and i % 10 and i != 21]
    saved = W.load_saved(spark, str(tmp_path / "out"))
    assert saved.count() == 3 * len(good) == manifest.agg(F.sum("n_rows")).first()[0]
    assert manifest.count() > 1 and "status" not in saved.columns


def test_image_folder(spark, tmp_path):
    for name in ("n01/a.png", "n01/b.JPG", "n02/c.jpeg", "n02/d.txt"):
        path = tmp_path / "images" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(3, 4))
    rows = R.read_image_folder(spark, str(tmp_path / "images")).collect()
    assert Counter(r["class"] for r in rows) == {"n01": 2, "n02": 1}


def test_memory_sources(spark):
    table = pa.table({"a": [1, 2], "b": ["x", "y"]})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    for data in (table, table.to_pydict(), table.to_pylist(), table.to_pandas(), sink.getvalue()):
        assert sorted(map(tuple, R.from_memory(spark, data).collect())) == [(1, "x"), (2, "y")]


def test_class_list_forms(spark):
    lines = spark.createDataFrame([("0 kit_fox",), ("{0: 'tench, Tinca tinca',",), (" 1: \"crow's nest\",",), (" 999: 'x'}",), ("",)], "text string")
    assert [tuple(r) for r in R.parse_class_list(lines).collect()] == [
        (0, "kit_fox"), (0, "tench, Tinca tinca"), (1, "crow's nest"), (999, "x")]


def test_json_field(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}]}, indent=1))
    assert sorted(r["a"] for r in R.read_json_field(spark, str(tmp_path), "data", "a: bigint").collect()) == [1, 2]


def test_shard_count():
    assert W.shard_count(10**9, max_shard_size="500MB") == 3
    assert W.shard_count(10, num_proc=4) == 4 and W.shard_count(10, num_shards=2) == 2
    with pytest.raises(ValueError):
        W.shard_count(10, 2, "1MB")
    assert W.parse_size("2KiB") == 2048 and W.parse_size("1.5GB") == 1_500_000_000


def test_saved_dataset_is_checked(spark, tmp_path):
    path = str(tmp_path / "ds")
    manifest = W.save_sharded(spark.range(103), ["id"], path, num_shards=4)
    assert sorted((r["shard"], r["n_rows"]) for r in manifest.collect()) == [
        (f"data-0000{i}-of-00004", n) for i, n in enumerate([26, 26, 26, 25])]
    assert W.load_saved(spark, path).count() == 103
    spark.range(1).selectExpr("9L as row_idx", "id", "'data-00000-of-00004' as shard").write.mode("append").partitionBy(
        "shard").parquet(path + "/data")
    with pytest.raises(ValueError, match="manifest"):
        W.load_saved(spark, path)


def test_publish_plan(spark):
    plan = W.publish_plan(spark, 40, 15, 16, compat_total=True).orderBy("shard_no").collect()
    assert [r["shard_no"] for r in plan] == list(range(15, 45))
    assert plan[0]["file_name"] == "train-00015-of-00030.parquet" and plan[-1]["file_name"] == "train-00044-of-00045.parquet"


def test_generator(spark):
    def numbers(start, n):
        for i in range(n):
            yield {"x": start + i}

    df = R.from_generator(spark, numbers, "x long", [{"start": 0, "n": 1500}, {"start": 5000, "n": 2}, {"start": 9, "n": 0}])
    assert df.count() == 1502 and df.agg(F.max("x")).first()[0] == 5001


def test_stream_resumes_without_repeating(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))
    spark.range(10).write.parquet(src)
    schema = spark.range(1).schema
    counts = []
    for step in range(3):
        if step == 2:
            spark.range(10, 15).write.mode("append").parquet(src)
        streams.run_available(streams.stream_files(spark, src, schema), out, progress)
        counts.append(spark.read.parquet(out).count())
    assert counts == [10, 10, 15]


def test_stream_shuffle_orders_each_micro_batch(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))
    streams.stage_shards(spark.range(400), ["id"], 4, src)
    stream = streams.stream_files(spark, src, spark.range(1).schema, files_per_trigger=1)
    streams.shuffle_buffer(stream, ["id"], 3, out, progress)
    rows = spark.read.parquet(out).orderBy("epoch", "place").collect()
    assert sorted(r["id"] for r in rows) == list(range(400))
    assert len({r["epoch"] for r in rows}) == 4 and [r["id"] for r in rows] != list(range(400))
    with pytest.raises(ValueError, match="more shards"):
        streams.stage_shards(spark.range(3), ["id"], 4, src + "x")


def test_download_resumes(spark, tmp_path):
    from captionforge.plans.acquire import download, downloaded

    calls = spark.sparkContext.accumulator(0)

    def fetcher():
        def get(url, attempt):
            calls.add(1)
            return (404, None) if url.endswith("3") else (200, url.encode())
        return get

    urls = spark.createDataFrame([(i, f"u{i}") for i in range(20)], "id long, url string")
    out = str(tmp_path / "dl")
    download(urls.where("id < 12"), "id", "url", out, fetcher, urls_per_task=5)
    download(urls, "id", "url", out, fetcher, urls_per_task=5)
    assert calls.value == 20
    images, failed = downloaded(spark, out, "id")
    assert images.count() == 18 and images.columns == ["id", "url", "content"]
    assert sorted(r["id"] for r in failed.collect()) == [3, 13]


def test_scratch_folder_is_the_named_one(tmp_path):
    from types import SimpleNamespace

    from captionforge.session import scratch_path, scratch_root

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://shared/cp/"))
    assert scratch_root(named) == "hdfs://shared/cp"
    assert scratch_path(named, "slices").startswith("hdfs://shared/cp/slices-")
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(cluster)


def test_archives_are_read_by_ranges_of_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "RANGE_BYTES", 4000)
    rng = random.Random(3)
    bodies = {}
    for name, members in (("a", 40), ("b", 1), ("none", 0)):
        with tarfile.open(tmp_path / f"{name}.tar", "w", format=tarfile.PAX_FORMAT) as tar:
            for i in range(members):
                # long names need headers of their own
                member = f"{'folder/' * (i % 30)}{i}.{'PNG' if i % 2 else 'json'}"
                body = rng.randbytes(rng.choice([0, 10, 600, 9000]))
                bodies[f"{name}.tar", member] = body
                info = tarfile.TarInfo(member)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    whole = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "junk.tar").write_bytes(b"no archive" * 1000)
    with tarfile.open(tmp_path / "packed.tar", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("empty.txt"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(str(tmp_path)).select("path")
    ranges = archives.archive_ranges(files).collect()
    assert len([r for r in ranges if r.archive.endswith("/a.tar")]) > 5
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    got = {(r.archive.rsplit("/", 1)[-1], r.member): bytes(r.content) for r in rows if r.member}
    assert {k: v for k, v in got.items() if k[0] in ("a.tar", "b.tar", "none.tar")} == bodies
    assert got["packed.tar", "empty.txt"] == b""
    cut = {m: v for (a, m), v in got.items() if a == "cut.tar"}
    assert len(cut) > 3 and all(bodies["a.tar", m] == v for m, v in cut.items())
    assert {r.archive.rsplit("/", 1)[-1] for r in rows if r.error} == {"cut.tar", "junk.tar"}


def test_pairs_of_an_archive_are_those_of_the_join(spark):
    def tar_of(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, body in members:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return out.getvalue()

    good = tar_of([("d/a.png", b"1"), ("d/a.json", b'{"key":"a"}'), ("b.json", b'{"key":"b"}'), ("c.PNG", b"3"), ("x/c.json", b'{"key":"c"}'),
                   ("e.f.png", b"5"), ("e.f.json", b'{"key":"e"}'), ("a.png", b"6"), ("g.png", b"7"), ("plain", b"8")])
    df = spark.createDataFrame([("one", good), ("two", tar_of([])), ("three", b"junk")], "path string, content binary")
    key = lambda r: (r.archive, r.stem, bytes(r.image), r.key)
    paired = sorted(map(key, archives.archive_pairs(df, "key string").collect()))
    assert paired == sorted(map(key, archives.join_sidecar(archives.tar_members(df), "key string").collect())) and len(paired) == 4


def test_versions_of_splits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ds")
    rows = lambda n: spark.range(n).withColumn("text", F.concat(F.lit("row "), "id"))
    assert W.versions(spark, path) == []
    with pytest.raises(ValueError):
        W.load_splits(spark, path)
    assert W.save_splits({"train": rows(50), "test": rows(7)}, path, ["id"], num_shards=3) == 1
    real = W.save_sharded

    def fails_at_test(df, order_by, folder, *args):
        if folder.endswith("/test"):
            raise OSError("disk full")
        return real(df, order_by, folder, *args)

    monkeypatch.setattr(W, "save_sharded", fails_at_test)
    with pytest.raises(OSError):
        W.save_splits({"train": rows(99), "test": rows(1)}, path, ["id"])
    # the old version is still the last one
    assert W.versions(spark, path) == [1] and W.load_splits(spark, path)["train"].count() == 50
    monkeypatch.setattr(W, "save_sharded", real)
    assert W.save_splits({"train": rows(20), "test": rows(0), "extra": rows(3)}, path, ["id"], num_shards=2) == 2
    now = W.load_splits(spark, path)
    assert {s: df.count() for s, df in now.items()} == {"train": 20, "test": 0, "extra": 3} and now["train"].columns == ["id", "text"]
    assert W.load_splits(spark, path, 1)["test"].count() == 7
    with pytest.raises(ValueError):
        W.load_splits(spark, path, 3)
    with pytest.raises(ValueError):
        W.save_splits({"a": rows(2), "b": spark.range(2)}, path, ["id"])


def test_reservoir_holds_rows_across_batches_and_restarts(spark, tmp_path):
    src, progress, out = (str(tmp_path / n) for n in ("src", "progress", "out"))
    schema = "id long"

    def run(lo, hi):
        for at in range(lo, hi):
            spark.range(at * 20, at * 20 + 20).coalesce(1).write.mode("append").parquet(src)
        streams.shuffle_reservoir(streams.stream_files(spark, src, schema, files_per_trigger=1), ["id"], 4, 3, out, progress)

    run(0, 4)
    assert streams.last_epoch(spark, out) == 3
    run(4, 7)  # a second run goes on with the rows held
    last = streams.last_epoch(spark, out)
    streams.drain(spark, schema, out, last, ["id"])
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(r.id for r in rows) == list(range(140)) and last == 6
    stays = [r.epoch - r.came for r in rows]
    assert set(stays) == {0, 1, 2} and all(r.came <= r.epoch <= last + 1 for r in rows)


def test_user_aggregates_merge_states(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD_STATES", 2)
    monkeypatch.setattr(M, "MERGED_TASKS", 2)
    df = spark.range(0, 600, 1, 7).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("k"), (F.col("id") % 3).alias("j"), F.col("id").alias("x"))
    update = lambda state, rows: merge(state or (), rows["x"].tolist())
    merge = lambda a, b: tuple(sorted({*a, *b})[-3:])
    got = M.aggregate_state(df, ["k", "j"], update, merge, lambda s: (list(s), len(s)), "top array<bigint>, n int").collect()
    want = {}
    for i in range(600):
        want.setdefault((str(i % 5) if i % 7 else None, i % 3), []).append(i)
    assert {(r.k, r.j): (r.top, r.n) for r in got} == {k: (v[-3:], 3) for k, v in want.items()}
    assert M.aggregate_state(df.limit(0), ["k"], update, merge, lambda s: (len(s),), "n int").count() == 0
