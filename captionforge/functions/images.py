"""Image header parsing for formats whose size is not at a fixed offset."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.functions.shapes import gif_size, png_size

# Markers of JPEG frame headers, and markers that stand alone.
_JPEG_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
_JPEG_ALONE = {0x01, *range(0xD0, 0xD9)}


def _jpeg_size(data: bytes) -> tuple[int | None, int | None]:
    at = 2
    while data[at] == 0xFF:
        while data[at] == 0xFF:  # a marker may be padded with any number of these
            at += 1
        marker, at = data[at], at + 1
        if marker in _JPEG_ALONE:
            continue
        if marker in _JPEG_FRAMES:
            height, width = struct.unpack(">HH", data[at + 3:at + 7])
            return width, height
        at += struct.unpack(">H", data[at:at + 2])[0]
    return None, None


def _webp_size(data: bytes) -> tuple[int | None, int | None]:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = struct.unpack("<I", data[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None, None


def _bmp_size(data: bytes) -> tuple[int | None, int | None]:
    if struct.unpack("<I", data[14:18])[0] == 12:
        return struct.unpack("<HH", data[18:22])
    width, height = struct.unpack("<ii", data[18:26])
    return width, abs(height)  # a negative height stores the rows from the top


def _tiff_size(data: bytes) -> tuple[int | None, int | None]:
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack(f"{order}HI", data[2:8])
    if magic != 42:
        return None, None
    sides: dict[int, int] = {}
    for i in range(struct.unpack(f"{order}H", data[at:at + 2])[0]):
        entry = data[at + 2 + 12 * i:at + 14 + 12 * i]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        if tag in (256, 257):
            sides[tag] = struct.unpack(f"{order}H", entry[8:10])[0] if kind == 3 else struct.unpack(f"{order}I", entry[8:12])[0]
    return sides.get(256), sides.get(257)


def header_size(data: bytes | None) -> tuple[int | None, int | None]:
    """(width, height) from PNG, GIF, JPEG, WebP, BMP or TIFF bytes; (None, None) when unreadable."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"\xff\xd8":
            return _jpeg_size(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_size(data)
        if data[:2] == b"BM":
            return _bmp_size(data)
        if data[:2] in (b"II", b"MM"):
            return _tiff_size(data)
    except (TypeError, struct.error, IndexError):
        pass
    return None, None


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
HEADER_BYTES = 1 << 17


@F.pandas_udf(_SIZE)
def _parsed_size(content: pd.Series) -> pd.DataFrame:
    sizes = pd.DataFrame([header_size(c) for c in content], columns=["width", "height"])
    return sizes.astype("Int32")


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG, GIF, JPEG, WebP, BMP or TIFF, null when unreadable.

    PNG and GIF keep their size at a fixed offset and are read in the JVM. Of the others the start
    goes to Python, and the whole body only of a JPEG or TIFF whose size lies beyond it.
    """
    kind = F.hex(F.substring(content, 1, 2))
    start = F.when(kind.isin("FFD8", "5249", "424D", "4949", "4D4D"), F.substring(content, 1, HEADER_BYTES))
    early = _parsed_size(start)
    late = _parsed_size(F.when(kind.isin("FFD8", "4949", "4D4D") & early["width"].isNull() & (F.length(content) > HEADER_BYTES), content))
    parsed = F.when(early["width"].isNotNull(), early).when(late["width"].isNotNull(), late)
    return F.coalesce(png_size(content), gif_size(content), parsed)


def unreadable(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, first bytes as hex) of the rows whose image has no readable size: the ledger of what a size filter drops."""
    sized = df.select(key, F.hex(F.substring(content, 1, 16)).alias("head"), image_size(F.col(content)).alias("__size"))
    return sized.where(F.col("__size.width").isNull()).drop("__size")
