"""Rounding and exact integer division, as columns. Half-even unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(n: Column, d: Column) -> Column:
    """Whole division of numbers that aren't negative."""
    return ((n - n % d) / d).cast("long")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def half_away(x: Column) -> Column:
    """Half away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def divide_half_away(n: Column, d: Column) -> Column:
    """Integers n / d (d > 0), half away from zero, without floats."""
    size = _div(F.abs(n) * 2 + d, d * 2)
    return F.when(n < 0, -size).otherwise(size).cast("long")


def divide_half_even(n: Column, d: Column) -> Column:
    """Integers n / d (d > 0), half to even, without floats."""
    whole = _div(F.abs(n), d)
    rest = F.abs(n) - whole * d
    up = (rest * 2 > d) | ((rest * 2 == d) & (whole % 2 == 1))
    size = whole + up.cast("long")
    return F.when(n < 0, -size).otherwise(size).cast("long")


def shift_to_zero(x: Column, bits: int) -> Column:
    """Division by a power of two, towards zero."""
    return (F.signum(x.cast("double")).cast("long") * F.shiftright(F.abs(x), bits)).cast("long")
