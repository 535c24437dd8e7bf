"""Signal and detection operators over samples: channel, t, id (ties of t), x."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbours_in_time(samples: DataFrame, block: int) -> DataFrame:
    """Adds ``before`` and ``after``: x of the samples next to each in its channel, null at the channel's ends.

    Windows run within blocks of ``block`` in time, so a hot channel is many groups; a row for each block holds its
    first and last x, and the blocks' ends get theirs from the blocks beside them.
    """
    s = samples.withColumn("_block", F.floor(F.col("t") / block))
    at = F.struct("t", "id", "x")
    ends = s.groupBy("channel", "_block").agg(F.min(at)["x"].alias("_first"), F.max(at)["x"].alias("_last"))
    beside = Window.partitionBy("channel").orderBy("_block")
    ends = ends.select("channel", "_block", F.lag("_last").over(beside).alias("_prev"), F.lead("_first").over(beside).alias("_next"))
    w = Window.partitionBy("channel", "_block").orderBy("t", "id")
    inner = s.withColumns({"before": F.lag("x").over(w), "after": F.lead("x").over(w), "_r": F.row_number().over(w), "_z": F.lead("id").over(w).isNull()})
    full = inner.join(ends, ["channel", "_block"])
    whole = full.withColumns({"before": F.when(F.col("_r") == 1, F.col("_prev")).otherwise(F.col("before")), "after": F.when(F.col("_z"), F.col("_next")).otherwise(F.col("after"))})
    return whole.select(*samples.columns, "before", "after")


def neo(samples: DataFrame, block: int = 86_400_000_000) -> DataFrame:
    """Adds ``neo``: x^2 - previous * next in the channel, zero at its ends."""
    near = neighbours_in_time(samples, block)
    return near.withColumn("neo", F.coalesce(F.col("x") * F.col("x") - F.col("before") * F.col("after"), F.lit(0.0))).drop("before", "after")


def thresholds(samples: DataFrame, neo_factor: float, mad_factor: float, least: float) -> DataFrame:
    """By channel: NEO threshold, threshold from the median absolute deviation, noise. Two grouped medians, one join."""
    middle = samples.groupBy("channel").agg(F.median("x").alias("med"), F.median(F.abs("neo")).alias("energy"))
    spread = samples.join(middle.select("channel", "med"), "channel").groupBy("channel").agg(F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"))
    out = middle.join(spread, "channel")
    return out.select("channel", (F.col("energy") * neo_factor / 0.6745).alias("neo_threshold"), F.greatest(F.col("mad") * 1.4826 * mad_factor, F.lit(least)).alias("mad_threshold"), (F.col("mad") / 0.6745).alias("noise"))


def wired_or(grid: DataFrame, wires: int) -> DataFrame:
    """Active electrodes (t, r, c, v): which survive shared row and column wires, judged over the whole frame
    (``by_frame``) and for each level of the ramp on its own (``by_level``)."""
    group = F.col("r") % wires

    def alone(*keys) -> F.Column:
        return F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1

    return grid.withColumns({"by_frame": alone("t", "r") | alone("t", group, "c"), "by_level": alone("t", "r", "v") | alone("t", group, "c", "v")})


def interval_match(peaks: DataFrame, detections: DataFrame, before: int, after: int, keys: list[str]) -> DataFrame:
    """Peaks with ``found``: the earliest detection of the same keys in [t - before, t + after], or null.

    A range join on equal bins: a peak meets the bins that its interval touches, detections only their own.
    """
    width = before + after
    bin_of = lambda t: F.floor(t / width)
    near = peaks.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("t") - before), bin_of(F.col("t") + after))))
    seen = detections.select(*keys, F.col("t").alias("_dt"), bin_of(F.col("t")).alias("_bin"))
    met = near.join(seen, [*keys, "_bin"]).where((F.col("_dt") >= F.col("t") - before) & (F.col("_dt") <= F.col("t") + after))
    first = met.groupBy("id").agg(F.min("_dt").alias("found"))
    return peaks.join(first, "id", "left")


def blocks(events: DataFrame, key: str, block: str, horizon: int) -> DataFrame:
    """By key and block: n, what earlier blocks held (``before``), what the last blocks hold (``rolling``), the change.

    Events are summed to blocks before any window, so a hot key is one row a block.
    """
    n = events.groupBy(key, block).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(block)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return n.withColumns({"before": before, "rolling": F.sum("n").over(w.rangeBetween(-horizon, 0)), "delta": F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0).cast("long"))})
