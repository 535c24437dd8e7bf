"""Events prepared from a recording: windows of samples, peaks, local peak-to-peak sizes, waveforms.

A signal is a table of chunks: channel, chunk, xs (``CHUNK`` samples from chunk * CHUNK on). Windows are an equi-join on
the one to three chunks that a window touches, and are cut once for each distinct time, however many events have it.
All channels of a probe meet in one row of a time: a probe is small, a recording isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.vectors import array_sum

#: Samples of a chunk.
CHUNK = 64


def inside(events: DataFrame, length: Column, before: int, after: int, strict: bool = False) -> DataFrame:
    """Events whose window [t - before, t + after) lies in the recording; ``strict``: also one sample short of its end."""
    t = F.col("t")
    return events.where((t >= before) & ((t + after < length) if strict else (t + after <= length)))


def windows(times: DataFrame, signal: DataFrame, before: int, after: int) -> DataFrame:
    """t, channel, xs: samples [t - before, t + after) at the distinct times, of their ``channel`` if they have one, else
    of all. Windows must lie in the recording."""
    keys = [c for c in ("t", "channel") if c in times.columns]
    first, last = F.floor((F.col("t") - before) / CHUNK), F.floor((F.col("t") + after - 1) / CHUNK)
    need = times.select(*keys).distinct().withColumns({"first": first, "chunk": F.explode(F.sequence(first, last))})
    parts = need.join(signal, ["chunk", *keys[1:]]).groupBy("t", "channel", "first").agg(F.array_sort(F.collect_list(F.struct("chunk", "xs"))).alias("parts"))
    xs = F.flatten(F.transform("parts", lambda p: p["xs"]))
    at = (F.col("t") - before - F.col("first") * CHUNK + 1).cast("int")
    return parts.select("t", "channel", F.slice(xs, at, before + after).alias("xs"))


def signed_peak(xs: Column) -> Column:
    """The first value of the largest size."""
    top = F.array_max(F.transform(xs, F.abs))
    return F.try_element_at(F.filter(xs, lambda x: F.abs(x) == top), F.lit(1))


def local_sizes(cut: DataFrame, neighbours: DataFrame, span: int) -> DataFrame:
    """t, central, xs (of the central channel), nbr, p2p: from windows of all channels. Peaks and peak-to-peak sizes are of
    the first ``span`` samples; the central channel has the largest peak, the first on a tie. ``neighbours``: channel,
    slot, nbr, of one probe."""
    near = F.slice("xs", 1, span)
    each = cut.select("t", "channel", "xs", F.abs(signed_peak(near)).alias("a"), (F.array_max(near) - F.array_min(near)).alias("p"))
    main = F.min(F.struct((-F.col("a")).alias("a"), "channel", "xs")).alias("main")
    by_time = each.groupBy("t").agg(main, F.map_from_entries(F.collect_list(F.struct("channel", "p"))).alias("sizes"))
    slots = neighbours.groupBy(F.col("channel").alias("central")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "nbr"))), lambda s: s["nbr"]).alias("nbr"))
    placed = by_time.select("t", F.col("main.channel").alias("central"), F.col("main.xs").alias("xs"), "sizes").join(F.broadcast(slots), "central")
    return placed.select("t", "central", "xs", "nbr", F.transform("nbr", lambda c: F.try_element_at(F.col("sizes"), c)).alias("p2p"))


def centre(sizes: str, nbr: str, at: dict[int, float], eps: float = 1e-8) -> Column:
    """Centre of mass of the sizes along one axis, by the probe's span, within [0, 1]. ``at``: place of each channel."""
    low, span = min(at.values()), max(at.values()) - min(at.values())
    if span <= eps:
        return F.lit(0.0)
    place = F.array(*[F.lit(float(at[c])) for c in range(len(at))])
    mass = F.greatest(array_sum(F.transform(sizes, lambda p: p.cast("double"))), F.lit(eps))
    moment = array_sum(F.zip_with(sizes, nbr, lambda p, c: p.cast("double") * F.get(place, c.cast("int"))))
    return F.least(F.greatest((moment / mass - low) / span, F.lit(0.0)), F.lit(1.0))


def size_codes(sizes: str, levels: int, mode: str, most: Column | None = None, lsb: float | None = None, clip: float = 2.0, eps: float = 1e-8) -> Column:
    """Codes in 0..levels of peak-to-peak sizes: by the event's largest, by the largest of all (``most``), by a step
    (``lsb``), or by the central slot; sizes as they are for ``none``."""
    p = F.transform(sizes, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    if mode == "none":
        return p
    own = F.col(sizes)[0].cast("double")
    scaled = {
        "per_spike_max": lambda x: x / F.greatest(F.array_max(p), F.lit(eps)) * levels,
        "global_max": lambda x: x / F.greatest(most.cast("double"), F.lit(eps)) * levels,
        "lsb": lambda x: x / F.lit(lsb),
        "central_ratio": lambda x: F.when(own > eps, F.least(x / own, F.lit(clip))).otherwise(0.0) / clip * levels,
    }[mode]
    return F.transform(p, lambda x: F.least(F.greatest(F.rint(scaled(x)), F.lit(0.0)), F.lit(float(levels))).cast("long"))
