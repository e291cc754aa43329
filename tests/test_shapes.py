"""Shape rules against plain Python, with ties, zero results and large sides."""

import struct

import pytest
from pyspark.sql import functions as F

from captionforge.functions import shapes
from captionforge.functions.images import header_size, image_size, unreadable


def nearest(value, patch):
    rest = value % patch
    return value + (patch - rest if patch - rest < rest else -rest)


def phase(first, second, limit, patch):
    if first > limit or second > limit:
        if second > first:
            dims = nearest(int(first * (limit / second)), patch), limit
        else:
            dims = limit, nearest(int(second * (limit / first)), patch)
    else:
        dims = nearest(first, patch), nearest(second, patch)
    return dims if min(dims) > 0 and not dims[0] % patch and not dims[1] % patch else None


@pytest.mark.parametrize("limit, patch", [(1024, 16), (512, 32), (1000, 16)])
def test_phase_dims(spark, limit, patch):
    sides = [(a, b) for a in range(1, 2100, 37) for b in range(1, 2100, 41)]
    sides += [(24, 8), (8, 8), (7, 30), (1024, 1024), (1025, 1025), (40, 40), (3000, 10), (10, 3000)]
    df = spark.createDataFrame(sides, "h int, w int")
    rows = df.select("h", "w", shapes.phase_dims(F.col("h"), F.col("w"), limit, patch).alias("d")).collect()
    for r in rows:
        assert (tuple(r["d"]) if r["d"] else None) == phase(r["h"], r["w"], limit, patch), (r["h"], r["w"])


def test_small_rules(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 31, 32, 33, 1023, 1024, 1025]], "n int")
    rows = df.select("n", shapes.pow2_down(F.col("n")).alias("d"), shapes.pow2_up(F.col("n")).alias("u"),
                     shapes.ceil_multiple(F.col("n"), 32).alias("c")).collect()
    for n, d, u, c in rows:
        assert d <= n < 2 * d and u // 2 < n <= u
        assert c == -(-n // 32) * 32


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 1024, 768) + b"\x08\x02"
    gif = b"GIF89a" + struct.pack("<HH", 33, 44)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\x03"
    assert header_size(jpeg) == (640, 480) and header_size(gif) == (33, 44)
    padded = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 65535) + b"x" * 65533) * 3 + jpeg[8:]
    df = spark.createDataFrame([(0, png), (1, gif), (2, jpeg), (3, b"junk"), (4, None), (5, padded)], "i int, b binary")
    rows = df.orderBy("i").select(shapes.png_size(F.col("b")).alias("p"), image_size(F.col("b")).alias("s")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in rows] == [(1024, 768), None, None, None, None, None]
    assert [tuple(r["s"]) if r["s"] else None for r in rows] == [(1024, 768), (33, 44), (640, 480), None, None, (640, 480)]
    probed = spark.createDataFrame([(png,)], "b binary").select(shapes.compat_probe(shapes.png_size(F.col("b"))).alias("c")).first()["c"]
    assert (probed["height"], probed["width"], probed["aspect_ratio"]) == (1024, 768, 0.75)


def test_headers_of_other_formats():
    tiff = b"II*\x00" + (200_000).to_bytes(4, "little") + b"\x00" * 199_992 + b"\x02\x00" + struct.pack("<HHII", 256, 4, 1, 640) + struct.pack(
        "<HHIHH", 257, 3, 1, 480, 0)
    assert header_size(tiff) == (640, 480) and header_size(tiff[:1000]) == (None, None)
    assert header_size(b"BM" + b"\x00" * 12 + struct.pack("<Iii", 40, 7, -9)) == (7, 9)
    assert header_size(b"BM" + b"\x00" * 12 + struct.pack("<IHH", 12, 7, 9)) == (7, 9)
    assert header_size(b"\xff\xd8\xff\xff\xff\xd0\xff\xc0\x00\x0b\x08\x00\x05\x00\x06") == (6, 5)
    assert header_size(b"\xff\xd8\x00\xc0\x00\x0b\x08\x00\x05\x00\x06") == (None, None)
    assert header_size(b"RIFF0000WEBPVP8 ") == (None, None)


def test_unreadable_images_are_listed(spark):
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    tiff = b"MM\x00*" + (150_000).to_bytes(4, "big") + b"\x00" * 149_992 + b"\x00\x02" + struct.pack(">HHII", 256, 4, 1, 64) + struct.pack(
        ">HHII", 257, 4, 1, 48)
    rows = spark.createDataFrame([(1, gif), (2, b"nothing"), (3, None), (4, tiff)], "id int, image binary")
    assert sorted(r["id"] for r in unreadable(rows, "id", "image").collect()) == [2, 3]
