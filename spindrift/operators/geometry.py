"""Probe geometry and features of footprints and waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.vectors import array_sum, total
from spindrift.operators.order import ranked

#: Offsets (row, column) of six neighbours, counter-clockwise from the right, for even and odd rows.
HEX = {0: [(0, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0)], 1: [(0, 1), (-1, 1), (-1, 0), (0, -1), (1, 0), (1, 1)]}


def grid(spark: SparkSession, channels: int, per_row: int, pitch: int = 20, stagger: int = 7) -> DataFrame:
    ch = F.col("id")
    return spark.range(channels).select(ch.alias("channel"), (ch % per_row * pitch).alias("x"), (F.floor(ch / per_row) * pitch + ch % 2 * stagger).alias("y"))


def neighbours(geometry: DataFrame, k: int, with_self: bool = False) -> DataFrame:
    """channel, slot, nbr: the nearest ``k`` channels, ties to the smaller. Geometry is a table of one probe."""
    other = geometry.select(F.col("channel").alias("nbr"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = geometry.join(F.broadcast(other), F.lit(True) if with_self else F.col("channel") != F.col("nbr"))
    d = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    r = ranked(pairs.withColumn("d", d), ["channel"], [F.col("channel") != F.col("nbr"), "d", "nbr"] if with_self else ["d", "nbr"], "r")
    return r.where(F.col("r") <= k).select("channel", (F.col("r") - 1).alias("slot"), "nbr")


def hex_neighbours(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """r, c, slot, nr, nc, valid: six neighbours of each electrode on staggered rows."""
    e = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    offsets = [F.array(*[F.struct(F.lit(k).cast("long").alias("slot"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(HEX[parity])]) for parity in (0, 1)]
    x = e.select("r", "c", F.inline(F.when(F.col("r") % 2 == 0, offsets[0]).otherwise(offsets[1])))
    nr, nc = F.col("r") + F.col("dr"), F.col("c") + F.col("dc")
    valid = nr.between(0, rows - 1) & nc.between(0, columns - 1)
    return x.select("r", "c", "slot", F.when(valid, nr).otherwise(F.col("r")).alias("nr"), F.when(valid, nc).otherwise(F.col("c")).alias("nc"), valid.alias("valid"))


def soft_location(events: DataFrame, sizes: str, at: list[float], span: float, eps: float = 1e-10) -> DataFrame:
    """Adds com, spread (both by the probe's span) and sharpness of a footprint whose slots lie at ``at``."""
    p = [F.col(sizes)[k] for k in range(len(at))]
    mass = F.greatest(total(p), F.lit(eps))
    com = total([v * a for v, a in zip(p, at, strict=True)]) / mass
    square = total([v * a * a for v, a in zip(p, at, strict=True)]) / mass
    spread = F.least(F.greatest(F.sqrt(F.greatest(square - com * com, F.lit(0.0))) / span, F.lit(0.0)), F.lit(1.0))
    return events.withColumns({"com": com / span, "spread": spread, "sharpness": F.array_max(sizes) / mass})


def slot_weights(events: DataFrame, sizes: str, temperature: float, unit: str = "unit") -> DataFrame:
    """slot, and weights that sum to 1: Fisher ratio, variance, softmax of means. Equal weights where all are 0."""
    long = events.select(unit, F.posexplode(sizes).alias("slot", "p"))
    by_unit = long.groupBy(unit, "slot").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("m"), F.var_pop("p").alias("v"))
    whole = long.groupBy("slot").agg(F.avg("p").alias("gm"), F.var_pop("p").alias("gv"))
    gap = F.col("m") - F.col("gm")
    ratio = by_unit.join(whole, "slot").groupBy("slot").agg((F.sum(F.col("n") * gap * gap) / F.greatest(F.sum(F.col("n") * F.col("v")), F.lit(1e-12))).alias("f"))
    raw = whole.join(ratio, "slot").withColumn("s", F.exp(F.col("gm") / temperature))
    sums = raw.agg(*[F.sum(c).alias(f"all_{c}") for c in ("f", "gv", "s")], F.count(F.lit(1)).alias("k"))
    share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}")).otherwise(1 / F.col("k"))
    return raw.crossJoin(F.broadcast(sums)).select(F.col("slot").cast("long").alias("slot"), share("f").alias("fisher"), share("gv").alias("variance"), share("s").alias("softmax"))


def profiles(events: DataFrame, sizes: str, slots: int, unit: str = "unit") -> DataFrame:
    """unit, profile: mean sizes scaled to sum 1."""
    means = events.groupBy(unit).agg(F.array(*[F.avg(F.col(sizes)[k]) for k in range(slots)]).alias("m"))
    return means.select(unit, F.transform("m", lambda x: x / F.greatest(array_sum(F.col("m")), F.lit(1e-12))).alias("profile"))


def apply_profiles(events: DataFrame, table: DataFrame, sizes: str, slots: int, unit: str = "unit") -> DataFrame:
    """Adds ``weighted``: sizes by the unit's profile; equal weights for units without one."""
    own = F.coalesce("profile", F.array(*[F.lit(1.0 / slots)] * slots))
    return events.join(table, unit, "left").withColumn("weighted", array_sum(F.zip_with(sizes, own, lambda a, b: a * b)))


def morphology(events: DataFrame, codes: str, key: str = "vec_id") -> DataFrame:
    """Twelve shape features of whole-number waveforms of 64 samples."""
    v = F.col(codes)
    lo, hi = F.array_min(v), F.array_max(v)
    part = lambda a, b: array_sum(F.slice(v, a + 1, b - a), "long")
    later = F.slice(v, 2, 63)
    turns = array_sum(F.zip_with(F.slice(v, 1, 63), later, lambda a, b: ((a >= 0) != (b >= 0)).cast("long")), "long")
    zero = F.lit(0).cast("long")
    return events.select(key, lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("p2p"), F.greatest(F.abs(lo), F.abs(hi)).alias("top"), (F.array_position(v, lo) - 1).alias("argmin"), (F.array_position(v, hi) - 1).alias("argmax"), part(0, 16).alias("early"), part(16, 40).alias("middle"), part(40, 64).alias("late"), array_sum(F.transform(v, lambda x: F.least(x, zero)), "long").alias("below"), array_sum(F.transform(v, lambda x: F.greatest(x, zero)), "long").alias("above"), turns.alias("turns"))
