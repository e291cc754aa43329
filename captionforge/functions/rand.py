"""Seeded randomness as a pure function of the row key.

``F.rand`` depends on partitioning, so a re-run or a retried task could draw other values.
Hashing the key instead gives the same draw on any layout, and in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits: exact in a double


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash_uniform(seed: int | str, *key) -> Column:
    """Uniform draw in [0, 1) from the seed and the key parts."""
    digest = F.md5(F.concat_ws("|", _text(seed), *[_text(k) for k in key]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(16.0**HEX_DIGITS)


def hash_normal(seed: int | str, *key) -> Column:
    """Standard normal draw (Box-Muller over two uniform draws)."""
    u1 = 1.0 - hash_uniform(seed, *key, "r")
    u2 = hash_uniform(seed, *key, "a")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
