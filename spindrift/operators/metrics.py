"""Metrics and storage formulas, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_lower(k: Column, n: Column, z: float = 1.645) -> Column:
    """Lower bound of a proportion; 0 without trials."""
    p = k / F.when(n > 0, n)
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.coalesce(F.when(n > 0, bound), F.lit(0.0))


def wilson_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = k / F.when(n > 0, n)
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def width(top: Column | int) -> Column:
    """Bits that hold the numbers 0 to ``top``."""
    top = top if isinstance(top, Column) else F.lit(top)
    return F.when(top > 0, F.floor(F.log2(top.cast("double"))) + 1).otherwise(1).cast("long")


def l1_row_bits(lanes: int, bits: int, top_radius: Column | int) -> Column:
    """A row with a centroid and a radius."""
    return F.lit(lanes * bits).cast("long") + width(top_radius)


def box_row_bits(lanes: int, bits: int) -> Column:
    return F.lit(2 * lanes * bits).cast("long")
