import gzip
import hashlib
import tempfile

import pytest
from pyspark.sql import types as T

from captionforge.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("shard", T.StringType())])


def rows():
    same, long = "gleich " * 40, "<p>é</p>" * 50_000
    pages = [(i, f"http://x/{i}", f"<html>{i}" + "z" * (i * 7 % 900), "a") for i in range(300)]
    pages += [(i, "http://copy", same, "b") for i in range(1000, 1300)]
    pages += [(500, None, None, None), (501, "u\r\nInjected: x", "", "c"), (502, "v", "short", "d"), (503, "v", "short", "d"), (504, "w", long, "e")]
    pages += [(999, "first", same, "t")] * 3 + [(None, "none", same, None)] * 2 + [(None, "none", "alone " * 30, None)]
    return pages


def brute(pages):
    out, first = [], {}
    for page, _, html, _ in pages:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    taken = set()
    for page, _, html, _ in pages:
        body = (html or "").encode()
        lead = first.get(body)
        revisit = lead is not None and (page != lead or body in taken)
        if page == lead:
            taken.add(body)
        out.append((page, "revisit" if revisit else "response", len(body), hashlib.sha256(body).hexdigest(), lead if revisit else None))
    return sorted(out, key=repr)


def write(spark, pages, **kwargs):
    folder = tempfile.mkdtemp(prefix="warc-") + "/archive"
    manifest = warc.write_archive(spark.createDataFrame(pages, PAGES), folder, **kwargs)
    return folder, sorted(manifest.collect(), key=lambda r: r.name)


@pytest.mark.parametrize("shard_bytes, file_bytes", [(1 << 25, 1 << 24), (40_000, 4_000)])
def test_round_trip(spark, shard_bytes, file_bytes):
    folder, manifest = write(spark, rows(), shard_bytes=shard_bytes, file_bytes=file_bytes)
    got = warc.read_archive(spark, folder).collect()
    fields = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=repr) == brute(rows())
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert {r.page_id: r.url for r in got}[501] == "u%0D%0AInjected:%20x"
    assert sum(m.records for m in manifest) == len(rows()) and (len(manifest) > 5) == (file_bytes == 4_000)


def test_same_rows_give_the_same_files(spark):
    small = {"shard_bytes": 40_000, "file_bytes": 8_000}
    one, first = write(spark, rows(), **small)
    two, second = write(spark, rows()[::-1], **small)
    assert [(m.name, m.sha256, m.bytes, m.records) for m in first] == [(m.name, m.sha256, m.bytes, m.records) for m in second]
    with open(f"{one}/{first[0].name}", "rb") as f:
        data = f.read()
    assert hashlib.sha256(data).hexdigest() == first[0].sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_commit_may_be_repeated_and_damage_is_found(spark):
    folder, manifest = write(spark, rows()[:40])
    assert warc.commit(spark, folder).count() == len(manifest)
    path = f"{folder}/{manifest[0].name}"
    with open(path, "rb") as f:
        data = gzip.decompress(f.read())
    with open(path, "wb") as f:
        f.write(gzip.compress(data.replace(b"<html>7", b"<html>8")))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, folder).collect()


def test_empty_table(spark):
    folder, manifest = write(spark, [])
    assert manifest == [] and warc.read_archive(spark, folder).count() == 0
