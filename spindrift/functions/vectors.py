"""Distances between array columns, and bit and code encoders of array columns.

``n`` unrolls a distance over the first n lanes, which stays in generated code outside lambdas.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.rounding import half_away, half_even


def total(parts: list[Column]) -> Column:
    return functools.reduce(operator.add, parts)


def array_sum(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))


def l1(a: Column, b: Column, n: int) -> Column:
    return total([F.abs(a[i] - b[i]) for i in range(n)])


def masked_l1(a: Column, b: Column, mask: Column, n: int) -> Column:
    """Over the lanes whose mask is 1."""
    return total([F.abs(a[i] - b[i]) * mask[i] for i in range(n)])


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def neg_dot(a: Column, b: Column) -> Column:
    return -array_sum(F.zip_with(a, b, lambda x, y: x * y))


def hamming(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x != y).cast("long")), "long")


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 where either norm is 0."""
    norm = F.sqrt(array_sum(F.transform(a, lambda x: x * x))) * F.sqrt(array_sum(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, -neg_dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two sets; ``empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(empty)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quantize_unsigned(x: Column, bits: int, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """One number to [0, 2^bits - 1]; a dimension without spread has scale 1."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    spread = F.when(high > low, high - low).otherwise(1.0)
    return half_even(clip((x - low) / spread, 0.0, 1.0) * (2**bits - 1))


def quantize_signed(x: Column, bits: int) -> Column:
    """[-1, 1] to [-(2^(bits-1) - 1), ...], half to even."""
    return half_even(clip(x, -1.0, 1.0) * (2 ** (bits - 1) - 1))


def quantize_signed_away(x: Column, scale: Column, bits: int = 5) -> Column:
    """Half away from zero after a power-of-two scale, clipped; the lowest code stays free."""
    top = 2 ** (bits - 1) - 1
    return F.least(F.greatest(half_away(x / scale * top), F.lit(-top)), F.lit(top)).cast("long")


def power_of_two_scale(q: Column) -> Column:
    return F.when(q > 0, F.pow(F.lit(2.0), F.ceil(F.log2(q)))).otherwise(1.0)


def remove_dc(w: Column) -> Column:
    return F.transform(w, lambda x: x - array_sum(w) / F.size(w))


def thermometer(w: Column, thresholds: list[float]) -> Column:
    """A bit for each threshold that a sample reaches, samples one after another."""
    return F.flatten(F.transform(w, lambda x: F.array(*[(x >= t).cast("int") for t in thresholds])))


def bipolar_thermometer(w: Column, positive: list[float], negative: list[float]) -> Column:
    plus, minus = F.transform(w, lambda x: F.greatest(x, F.lit(0.0))), F.transform(w, lambda x: F.greatest(-x, F.lit(0.0)))
    return F.concat(thermometer(plus, positive), thermometer(minus, negative))


def peak_normalize(w: Column, eps: float = 1e-8) -> Column:
    top = F.greatest(F.array_max(F.transform(w, lambda x: F.abs(x))), F.lit(eps))
    return F.transform(w, lambda x: x / top)
