"""Row banks: what a class ("unit") is known by, fitted by grouped aggregates, and retrieval of events by them.

A bank is a small table, one row per unit (or per prototype of one) in the order of ``row_id``. For retrieval it
becomes one row that holds an array of its rows and is broadcast: an event's distances, candidates and nearest
row are array expressions of its own row, without a shuffle of events. A bank of over ``MOST_ROWS`` rows isn't
gathered: events then meet it by a join and their rows are grouped again, with equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a bank that one broadcast row may hold.
MOST_ROWS = 4096


def centroids(events: DataFrame, lanes: int, unit: str = "unit", codes: str = "q", rounded: bool = True, by: list[str] | None = None) -> DataFrame:
    """unit, n, centroid: per-lane means, rounded half to even; one shuffle with partial sums."""
    mean = [F.avg(F.col(codes)[i]) for i in range(lanes)]
    made = F.array(*[F.rint(m).cast("long") if rounded else m for m in mean])
    return events.groupBy(*(by or [unit])).agg(F.count(F.lit(1)).alias("n"), made.alias("centroid"))


def with_own(events: DataFrame, bank: DataFrame, *columns: str, unit: str = "unit") -> DataFrame:
    """Events with columns of their own unit's row."""
    return events.join(F.broadcast(bank.select(unit, *columns)) if _fits(bank) else bank.select(unit, *columns), unit)


def settled(bank: DataFrame) -> DataFrame:
    """The bank as a fixed small table, so that later steps don't fit it again; one of over ``MOST_ROWS`` rows as it is."""
    rows = bank.limit(MOST_ROWS + 1).collect()
    return bank if len(rows) > MOST_ROWS else bank.sparkSession.createDataFrame(rows, bank.schema)


def _fits(bank: DataFrame) -> bool:
    return len(bank.select(bank.columns[0]).limit(MOST_ROWS + 1).collect()) <= MOST_ROWS


def ceil_percentile(x: Column, percent: float) -> Column:
    """Ceiling of an exact, interpolated percentile; what interpolation adds to a whole number doesn't count."""
    return F.ceil(F.round(F.percentile(x, F.lit(percent / 100)), 9)).cast("long")


def radii(events: DataFrame, bank: DataFrame, distance: Callable[[Column, Column], Column], percent: float, name: str = "radius", unit: str = "unit", codes: str = "q") -> DataFrame:
    """Adds the ceiling of an exact percentile of each unit's distances to its own centroid."""
    own = with_own(events, bank, "centroid", unit=unit).select(unit, distance(F.col(codes), F.col("centroid")).alias("d"))
    found = own.groupBy(unit).agg(ceil_percentile(F.col("d"), percent).alias(name))
    return bank.join(found, unit, "left")


def boxes(events: DataFrame, bank: DataFrame, distance: Callable[[Column, Column], Column], coverage: float, lanes: int, order: str, unit: str = "unit", codes: str = "q") -> DataFrame:
    """Adds lo and hi: the range per lane of the closest ceil(coverage * n) codes, widened to hold the centroid."""
    own = with_own(events, bank, "centroid", "n", unit=unit).withColumn("d", distance(F.col(codes), F.col("centroid")))
    near = own.withColumn("r", F.row_number().over(Window.partitionBy(unit).orderBy("d", order))).where(F.col("r") <= F.ceil(F.col("n") * coverage))
    ends = near.groupBy(unit).agg(F.array(*[F.min(F.col(codes)[i]) for i in range(lanes)]).alias("a"), F.array(*[F.max(F.col(codes)[i]) for i in range(lanes)]).alias("b"))
    full = bank.join(ends, unit, "left")
    lo = F.array(*[F.least(F.col("centroid")[i], F.col("a")[i]) for i in range(lanes)])  # nulls are skipped
    hi = F.array(*[F.greatest(F.col("centroid")[i], F.col("b")[i]) for i in range(lanes)])
    return full.withColumns({"lo": lo, "hi": hi}).drop("a", "b")


def numbered(bank: DataFrame, *order: str) -> DataFrame:
    """row_id (long, from 0) in the order of ``order`` (default: unit). A bank is small: one task numbers it."""
    return bank.withColumn("row_id", (F.row_number().over(Window.orderBy(*(order or ("unit",)))) - 1).cast("long"))


def met(events: DataFrame, bank: DataFrame, values: dict[str, Callable[[Column], Column]], event: str = "vec_id") -> DataFrame:
    """Events with ``rows``: array<struct<row_id, unit, *values>> over the bank in the order of row_id.

    ``values``: expressions of a bank row (a struct); they may use the event's columns.
    """
    columns = ["row_id", *(c for c in bank.columns if c != "row_id")]

    def row(u: Column) -> Column:
        return F.struct(u["row_id"].alias("row_id"), u["unit"].alias("unit"), *(f(u).alias(k) for k, f in values.items()))

    if _fits(bank):
        one = bank.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_bank"))
        return events.crossJoin(F.broadcast(one)).withColumn("rows", F.transform("_bank", row)).drop("_bank")
    pairs = events.join(bank.select(F.struct(*columns).alias("_u")))
    rows = pairs.withColumn("_row", row(F.col("_u"))).groupBy(event).agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    return events.join(rows, event)


def units_where(rows: str | Column, holds: Callable[[Column], Column]) -> Column:
    """Units of the rows that hold, in the order of rows, each once."""
    return F.array_distinct(F.transform(F.filter(rows, holds), lambda r: r["unit"]))


def nearest(rows: str | Column, score: Callable[[Column], Column]) -> Column:
    """The row of least score, the first on a tie."""
    return F.array_min(F.transform(rows, lambda r: F.struct(score(r).alias("score"), r["row_id"].alias("row_id"), r["unit"].alias("unit"))))


def inside_box(u: Column, codes: Column, lanes: int, level: int | Column = 0) -> Column:
    out = F.lit(True)
    for i in range(lanes):
        out = out & (codes[i] >= u["lo"][i] - level) & (codes[i] <= u["hi"][i] + level)
    return out


def box_excess(u: Column, codes: Column, lanes: int) -> Column:
    """Least level at which the box holds the codes."""
    return F.greatest(F.lit(0).cast("long"), *[F.greatest(u["lo"][i] - codes[i], codes[i] - u["hi"][i]) for i in range(lanes)])


def widened(rows: str | Column, need: Callable[[Column], Column], steps: int) -> tuple[Column, Column]:
    """(candidates, level): the first level up to ``steps`` at which any row holds; none and null beyond."""
    level = F.array_min(F.transform(rows, lambda r: F.greatest(F.lit(0).cast("long"), need(r))))
    level = F.when(level <= steps, level)
    return F.when(level.isNotNull(), units_where(rows, lambda r: need(r) <= level)).otherwise(F.array().cast("array<int>")), level


def rank_weights(ranks: Column, scheme: str) -> Column:
    """Power-of-two weights of lanes by rank (from 1): ``top3_x4`` or ``tiered_421``."""
    if scheme == "top3_x4":
        return F.when(ranks <= 3, 4).otherwise(1)
    return F.when(ranks <= 3, 4).when(ranks <= 6, 2).otherwise(1)
