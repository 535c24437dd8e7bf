"""Synthetic recordings: a staggered grid, spatially decaying templates, Poisson trains with a refractory time, noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.geometry import grid
from spindrift.operators.kernels import refractory


def trains(spark: SparkSession, neurons: int, seconds: float, fs: int, rate: float = 8.0, gap: float = 0.002, seed: int = 0) -> DataFrame:
    """neuron, t: each neuron's spike times, made by its own task from its own seed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["neuron"].iloc[0])
        rng = np.random.default_rng([seed, n])
        t = np.sort((rng.random(rng.poisson(rate * seconds)) * seconds * fs).astype(np.int64))
        t = t[refractory(t, int(gap * fs))]
        return pd.DataFrame({"neuron": n, "t": t})

    return spark.range(neurons).withColumnRenamed("id", "neuron").groupBy("neuron").applyInPandas(run, "neuron long, t long")


def synthetic_recording(spark: SparkSession, neurons: int = 6, channels: int = 16, seconds: float = 1.0, fs: int = 10000, noise: float = 5.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, samples channel t x, events neuron t): templates of 32 samples fall with the distance from the
    neuron, sums are grouped by channel and time, noise comes from a hash of both."""
    geometry = grid(spark, channels, 4)
    events = trains(spark, neurons, seconds, fs, seed=seed)
    place = spark.range(neurons).select(F.col("id").alias("neuron"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(60))).alias("nx"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(channels * 5)).alias("ny"), (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(60)) + 60).alias("height"))
    away = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    reach = geometry.join(F.broadcast(place), F.lit(True)).select("channel", "neuron", (F.col("height") * F.exp(-away / 800)).alias("size")).where("size > 0.5")
    shape = F.array(*[F.struct(F.lit(k - 8).alias("k"), F.lit(float(-np.exp(-((k - 8) ** 2) / 6) + 0.4 * np.exp(-((k - 16) ** 2) / 30))).alias("v")) for k in range(32)])
    waves = events.join(F.broadcast(reach), "neuron").select("channel", "t", "size", F.inline(shape)).groupBy("channel", (F.col("t") + F.col("k")).alias("t")).agg(F.sum(F.col("size") * F.col("v")).alias("v"))
    clock = spark.range(int(seconds * fs)).withColumnRenamed("id", "t").join(F.broadcast(geometry.select("channel")), F.lit(True))
    u = lambda k: (F.pmod(F.xxhash64("channel", "t", F.lit(seed + k)), F.lit(1 << 30)) + 1) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(u(11))) * F.cos(2 * np.pi * u(12))
    samples = clock.join(waves, ["channel", "t"], "left").select("channel", "t", (F.coalesce("v", F.lit(0.0)) + normal * noise).alias("x"))
    return geometry, samples, events
