"""Array-column functions for latents, text states and feature vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_normal, hash_uniform

NULL_PROBABILITIES = {"pooled": 0.1, "first": 0.316, "second": 0.316}
TEXT_STEPS = 77
MASK_FRACTION = 0.25


def scale_unit(v: Column) -> Column:
    """[0, 1] to [-1, 1]."""
    return F.transform(v, lambda x: 2.0 * x - 1.0)


def scale_signed(v: Column) -> Column:
    """Bytes to [-1, 1]."""
    return F.transform(v, lambda x: (x - 127.5) / 127.5)


def unscale_signed(v: Column) -> Column:
    return F.transform(v, lambda x: x * 127.5 + 127.5)


def to_pixels(v: Column) -> Column:
    """[-1, 1] to whole byte values, clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), ((x + 1.0) / 2.0 * 255.0).cast("int"))))


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def pad_truncate(v: Column, length: int, pad: Column, side: str = "right") -> Column:
    """Exactly ``length`` elements: cut the tail, or pad on the given side."""
    kept = F.slice(v, 1, length)
    padding = F.array_repeat(pad, F.lit(length) - F.least(F.size(v), F.lit(length)))
    return F.concat(padding, kept) if side == "left" else F.concat(kept, padding)


def attention_mask(v: Column, length: int, side: str = "right") -> Column:
    return pad_truncate(F.transform(v, lambda _: F.lit(1)), length, F.lit(0), side)


def apply_mask(v: Column, mask: Column) -> Column:
    return F.zip_with(v, mask, lambda x, m: x * m)


def pad_concat(wide: Column, narrow: Column) -> Column:
    """Zero-pad ``narrow`` to the width of ``wide`` and append it."""
    return F.concat(wide, narrow, zeros(F.size(wide) - F.size(narrow)))


def pad_sentinel(v: Column, length) -> Column:
    """Pad with +inf to ``length`` so the receiver can recover the true size."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.concat(v, F.array_repeat(F.lit(float("inf")), length - F.size(v)))


def drop_sentinel(v: Column) -> Column:
    return F.filter(v, lambda x: x != float("inf"))


def cond_dropout_flags(seed: int, *key) -> dict[str, Column]:
    """Independent per-row drops of the three conditioning parts."""
    return {f"drop_{name}": hash_uniform(seed, *key, name) < p for name, p in NULL_PROBABILITIES.items()}


def drop_vector(v: Column, dropped: Column) -> Column:
    return F.when(dropped, F.transform(v, lambda x: x * 0.0)).otherwise(v)


def drop_steps(v: Column, drop_first: Column, drop_second: Column, steps: int = TEXT_STEPS) -> Column:
    """Zero the first ``steps`` elements, the rest, or both."""
    def keep(x, i):
        dropped = F.when(i < steps, drop_first).otherwise(drop_second)
        return F.when(dropped, x * 0.0).otherwise(x)

    return F.transform(v, keep)


def token_mask(v: Column, drop_first: Column, drop_second: Column, seed: int, *key, steps: int = TEXT_STEPS,
               fraction: float = MASK_FRACTION) -> Column:
    """True where a step is masked: drawn with ``fraction`` and its condition is dropped."""
    return F.transform(
        v, lambda _, i: (hash_uniform(seed, *key, i) < fraction) & F.when(i < steps, drop_first).otherwise(drop_second)
    )


def time_sample(seed: int, *key, weighted: bool = True, m: float = 0.0, s: float = 1.0) -> Column:
    """Noise level in (0, 1): logistic-normal, or uniform."""
    if not weighted:
        return hash_uniform(seed, *key)
    return 1.0 / (1.0 + F.exp(-(hash_normal(seed, *key) * s + m)))


def noise_like(v: Column, seed: int, *key) -> Column:
    return F.transform(v, lambda _, i: hash_normal(seed, *key, i))


def noise_mix(v: Column, eps: Column, t: Column) -> Column:
    return F.zip_with(v, eps, lambda x, e: (1.0 - t) * x + t * e)


def velocity(v: Column, eps: Column) -> Column:
    return F.zip_with(v, eps, lambda x, e: e - x)


def lognorm_weight(t: Column, m: float = 0.0, s: float = 1.0) -> Column:
    odds = t / (1.0 - t)
    density = F.exp(-((F.log(odds) - m) ** 2) / (2.0 * s * s)) / (s * math.sqrt(2.0 * math.pi)) / (t * (1.0 - t))
    return odds * density


def masked_mse(a: Column, b: Column, mask: Column | None = None) -> Column:
    """Mean over all elements of the squared error, masked elements counting as zero."""
    squared = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    if mask is not None:
        squared = F.zip_with(squared, mask, lambda e, m: e * m.cast("double"))
    return F.aggregate(squared, F.lit(0.0).cast("double"), lambda acc, e: acc + e) / F.size(a)
