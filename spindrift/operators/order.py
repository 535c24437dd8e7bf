"""Chronological splits, ranks and set operators. Ties are always broken by a column that is named.

Split boundaries never divide rows of equal time. They come from the value at a rank, found by radix narrowing:
each pass counts rows in at most 65,536 buckets, so no task sorts or holds all times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BITS = 16


def value_at_rank(df: DataFrame, t: str, rank: int) -> int:
    """The value of integer column ``t`` at ``rank`` (from 0) of its ascending order."""
    bounds = df.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    low, width = bounds["a"], max(bounds["b"] - bounds["a"], 0).bit_length()
    while width > 0:
        shift = max(0, width - _BITS)
        bucket = F.shiftright(F.col(t).cast("long") - low, shift)
        inside = df.where((F.col(t) >= low) & (F.col(t) < low + (1 << width)))
        for r in sorted(inside.groupBy(bucket.alias("k")).count().collect()):  # at most 2^16 rows
            if rank < r["count"]:
                low += r["k"] << shift
                break
            rank -= r["count"]
        width = shift
    return low


def boundaries_near(df: DataFrame, t: str, *fractions: float) -> tuple[int, list[tuple[int, int]]]:
    """(rows, boundaries): a boundary is (rows up to it, largest time before it). Of times that span at most 2^16
    values one count gives all boundaries; of others, those next to each fraction of the rows."""
    c = df.agg(F.count(F.col(t)).alias("n"), F.min(t).alias("a"), F.max(t).alias("b")).first()
    n = c["n"]
    if not n:
        return 0, []
    if (c["b"] - c["a"]).bit_length() <= _BITS:
        out, total = [], 0
        for r in sorted(df.where(F.col(t).isNotNull()).groupBy(F.col(t).alias("t")).count().collect()):
            total += r["count"]
            out.append((total, r["t"]))
        return n, out
    return n, sorted({x for f in fractions for x in _around(df, t, min(n - 1, int(n * f)))})


def _around(df: DataFrame, t: str, rank: int) -> list[tuple[int, int]]:
    """The boundaries after and before the value at ``rank``, and one further on each side."""
    at = value_at_rank(df, t, rank)
    c = df.agg(F.count(F.when(F.col(t) < at, 1)).alias("below"), F.count(F.when(F.col(t) <= at, 1)).alias("upto"), F.max(F.when(F.col(t) < at, F.col(t))).alias("before"), F.min(F.when(F.col(t) > at, F.col(t))).alias("next")).first()
    out = [(c["upto"], at)]
    if c["below"] or c["next"] is not None:
        d = df.agg(F.count(F.when(F.col(t) < c["before"], 1)).alias("n"), F.max(F.when(F.col(t) < c["before"], F.col(t))).alias("t"), F.count(F.when(F.col(t) <= c["next"], 1)).alias("m")).first()
        if c["below"]:
            out.append((c["below"], c["before"]))
        if d["n"]:
            out.append((d["n"], d["t"]))
        if c["next"] is not None:
            out.append((d["m"], c["next"]))
    return out


def split_time(df: DataFrame, t: str, fraction: float = 0.5) -> int | None:
    """Largest time of the first part: the boundary nearest to ``fraction`` of the rows, the earlier on a tie."""
    n, near = boundaries_near(df, t, fraction)
    return min(near, key=lambda b: (abs(b[0] - n * fraction), b[0]), default=(0, None))[1]


def split_two(df: DataFrame, t: str, fraction: float = 0.5) -> DataFrame:
    """Adds ``part``: 0 before the boundary, 1 after it."""
    return df.withColumn("part", (F.col(t) > F.lit(split_time(df, t, fraction))).cast("int"))


def split_three(df: DataFrame, t: str, first: float = 0.5, second: float = 0.75) -> DataFrame:
    """Adds ``part`` 0, 1, 2: the two boundaries of least squared distance from the fractions, earlier on a tie."""
    n, near = boundaries_near(df, t, first, second)
    near = [b for b in near if b[0] < n]
    # The squared distance is separable: only the few boundaries nearest to each target can be best.
    close = lambda f: sorted(sorted(near, key=lambda b: (abs(b[0] - n * f), b[0]))[:3])
    pairs = [((a[0] - n * first) ** 2 + (b[0] - n * second) ** 2, a[0], b[0], a[1], b[1]) for a in close(first) for b in close(second) if a[0] < b[0]]
    _, _, _, t1, t2 = min(pairs)
    return df.withColumn("part", (F.col(t) > t1).cast("int") + (F.col(t) > t2).cast("int"))


def naive_split(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """The first int(n * fraction) rows in order; this can divide equal times. Rows with equal keys count one by one."""
    n = int(df.count() * fraction)
    at = value_at_rank(df, order[0], n) if n < df.count() else None
    if at is None:
        return df.withColumn("part", F.lit(0))
    below = df.where(F.col(order[0]) < at).count()
    tied = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:]))
    return df.withColumn("_n", tied).withColumn("part", ((F.col(order[0]) > at) | ((F.col(order[0]) == at) & (F.col("_n") > n - below))).cast("int")).drop("_n")


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rank from 1 within ``by``; ``order`` must end in a column that breaks ties."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    return ranked(df, by, order, "_rank").where(F.col("_rank") <= k).drop("_rank")


def numbered(df: DataFrame, order: list[Column | str], buckets: list[Column], name: str) -> DataFrame:
    """Numbers all rows from 1 in ``order``, which must end in a column that breaks ties and holds no nulls. ``buckets``
    rise with the order and take at most about 2^16 values together: rows are sorted within their bucket only, and
    offsets come from the buckets' counts."""
    keys = [f"_bucket{i}" for i in range(len(buckets))]
    marked = df.withColumns(dict(zip(keys, buckets, strict=True)))
    up_to = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    before = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(up_to), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return marked.withColumn(name, inside).join(before, keys).withColumn(name, F.col(name) + F.col("_before")).drop(*keys, "_rows", "_before")


def high_bits(df: DataFrame, key: str, bits: int) -> Column:
    """The ``bits`` highest bits of the span of integer column ``key``: rises with the key, at most 2^bits values."""
    c = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    low, width = (c["a"], (c["b"] - c["a"]).bit_length()) if c["a"] is not None else (0, 0)
    return F.shiftright(F.col(key).cast("long") - low, max(0, width - bits))


def changes(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Rows at which ``column`` differs from the row before, the first included."""
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_same", before.eqNullSafe(F.col(column))).where(~F.col("_same")).drop("_same")


def minimal_coverage(counts: DataFrame, by: list[str], n: str, tie: str, coverage: float) -> DataFrame:
    """Of counted values, the most frequent ones (ties: smaller) until they reach ``coverage`` of the group."""
    order = Window.partitionBy(*by).orderBy(F.desc(n), tie).rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumns({"_cum": F.sum(n).over(order), "_all": F.sum(n).over(Window.partitionBy(*by))})
    return cumulated.where(F.col("_cum") - F.col(n) < F.ceil(F.col("_all") * coverage)).drop("_cum", "_all")
