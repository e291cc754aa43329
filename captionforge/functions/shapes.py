"""Image-shape arithmetic.

The build scripts this engine is compatible with read an image's (width, height) pair into
variables named ``height, width``. Functions here therefore take the pair as
``first, second``; a bucket string ``"{first}x{second}"`` reads width x height.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SIDE = 1024
PATCH = 16
MIN_SIDE = 256


def nearest_multiple(value: Column, step: int) -> Column:
    """Nearest multiple of ``step``; exactly half way rounds down."""
    rest = value % step
    return value + F.when(F.lit(step) - rest < rest, F.lit(step) - rest).otherwise(-rest)


def phase_dims(first: Column, second: Column, max_side: int = MAX_SIDE, patch: int = PATCH) -> Column:
    """struct(height, width) of the resized image, null when the resize would fail."""
    limit = F.lit(max_side)
    too_big = (first > limit) | (second > limit)
    second_longer = second > first
    scaled_first = nearest_multiple((first * (limit / second)).cast("int"), patch)
    scaled_second = nearest_multiple((second * (limit / first)).cast("int"), patch)
    height = F.when(too_big, F.when(second_longer, scaled_first).otherwise(limit)).otherwise(
        nearest_multiple(first, patch)
    ).cast("int")
    width = F.when(too_big, F.when(second_longer, limit).otherwise(scaled_second)).otherwise(
        nearest_multiple(second, patch)
    ).cast("int")
    fits = (height > 0) & (width > 0) & (height % patch == 0) & (width % patch == 0)
    return F.when(fits, F.struct(height.alias("height"), width.alias("width")))


def is_high_resolution(first: Column, second: Column, min_side: int = MIN_SIDE) -> Column:
    return (first >= min_side) | (second >= min_side)


def cap_longest_side(width: Column, height: Column, limit: int = 512) -> Column:
    """struct(width, height) with the longest side at most ``limit``."""
    wide = width > height
    new_width = F.when(wide & (width > limit), F.lit(limit)).when(
        ~wide & (height > limit), (width / height * limit).cast("int")
    ).otherwise(width)
    new_height = F.when(wide & (width > limit), (height / width * limit).cast("int")).when(
        ~wide & (height > limit), F.lit(limit)
    ).otherwise(height)
    return F.struct(new_width.cast("int").alias("width"), new_height.cast("int").alias("height"))


def ceil_multiple(value: Column, step: int) -> Column:
    return F.floor((value + (step - 1)) / step) * step


# Every power of two an int side can reach; comparing against them avoids float logarithms,
# which can land on the wrong side of an exact power.
_POWERS = [1 << i for i in range(31)]


def pow2_down(value: Column) -> Column:
    return F.aggregate(F.array(*map(F.lit, _POWERS)), F.lit(1),
                       lambda acc, p: F.when(p <= value, p).otherwise(acc))


def pow2_up(value: Column) -> Column:
    down = pow2_down(value).cast("long")
    return F.when(down == value, down).otherwise(down * 2)


def token_count(height: Column, width: Column, patch: int = 2, downsample: int = 8) -> Column:
    """Transformer tokens of an image: latent sides are image sides / ``downsample``."""
    per_side = lambda side: F.ceil(F.floor(side / downsample) / patch)
    return per_side(height) * per_side(width)


PNG_SIGNATURE = "89504E470D0A1A0A"


def png_size(content: Column) -> Column:
    """struct(width, height) read from a PNG header, null for other bytes."""
    field = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    is_png = (F.hex(F.substring(content, 1, 8)) == PNG_SIGNATURE) & (
        F.hex(F.substring(content, 13, 4)) == F.hex(F.lit("IHDR"))
    )
    return F.when(is_png, F.struct(field(17).alias("width"), field(21).alias("height")))


def gif_size(content: Column) -> Column:
    """struct(width, height) read from a GIF header, null for other bytes."""
    def field(at: int) -> Column:
        low, high = (F.conv(F.hex(F.substring(content, p, 1)), 16, 10).cast("int") for p in (at, at + 1))
        return high * 256 + low

    is_gif = F.hex(F.substring(content, 1, 6)).isin("474946383761", "474946383961")
    return F.when(is_gif, F.struct(field(7).alias("width"), field(9).alias("height")))


def compat_probe(size: Column) -> Column:
    """struct(height, width, aspect_ratio) with the swapped names the build scripts store."""
    return F.when(
        size.isNotNull() & (size["width"] > 0),
        F.struct(
            size["width"].alias("height"),
            size["height"].alias("width"),
            (size["height"] / size["width"]).alias("aspect_ratio"),
        ),
    )

