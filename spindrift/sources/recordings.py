"""Recordings as tables. Files come through Spark's binaryFile source, so any store that Spark reads will do; a file is
decoded by one task and leaves it as chunks of samples, never as a row a sample.

An NPZ recording holds raw_data (channels x samples, or samples x channels, told apart by which is longer), geom
(channels x 2), fs, spike_times_0based and spike_unit_ids (numbers, or strings like ``#3``).
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number types of the MDA format (fixed values of the format).
MDA_TYPES = {-2: "u1", -3: "<f4", -4: "<i2", -5: "<i4", -6: "<u2", -7: "<f8", -8: "<u4"}


def _name(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


def _load(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        out = {k: z[k] for k in z.files}
    x = out["raw_data"]
    if "geom" in out and x.shape[0] != len(out["geom"]) or "geom" not in out and x.shape[0] > x.shape[1]:
        out["raw_data"] = x.T
    return out


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def chunks(spark: SparkSession, path: str, block: int = 20_000, duration_s: float | None = None) -> DataFrame:
    """recording, channel, block, t0, fs, x (array<double>); only the first ``duration_s`` seconds if given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                r = _load(content)
                fs = float(r.get("fs", 30000))
                x = r["raw_data"] if duration_s is None else r["raw_data"][:, : int(fs * duration_s)]
                for b, t0 in enumerate(range(0, x.shape[1], block)):
                    yield pd.DataFrame({"recording": _name(name), "channel": range(len(x)), "block": b, "t0": t0, "fs": fs, "x": list(x[:, t0 : t0 + block].astype(float))})

    return _files(spark, path, "*.npz").mapInPandas(run, "recording string, channel int, block long, t0 long, fs double, x array<double>")


def ground_truth(spark: SparkSession, path: str, duration_s: float | None = None) -> DataFrame:
    """recording, event_row_id, t, unit: true events in the file's order; simultaneous ones stay rows of their own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                r = _load(content)
                units = pd.Series(r["spike_unit_ids"]).astype(str).str.lstrip("#").astype("int64")
                out = pd.DataFrame({"recording": _name(name), "event_row_id": range(len(units)), "t": r["spike_times_0based"].astype("int64"), "unit": units})
                end = r["raw_data"].shape[1] if duration_s is None else float(r.get("fs", 30000)) * duration_s
                yield out[(out["t"] >= 0) & (out["t"] < end)]

    return _files(spark, path, "*.npz").mapInPandas(run, "recording string, event_row_id long, t long, unit long")


def read_mda_bytes(content: bytes) -> np.ndarray:
    """An array of the MDA format: type, bytes of a number, dimensions (64-bit if their count is negative), numbers in
    column-major order."""
    code, _, n = struct.unpack_from("<iii", content)
    wide, n = n < 0, abs(n)
    shape = struct.unpack_from(f"<{n}{'q' if wide else 'i'}", content, 12)
    at = 12 + n * (8 if wide else 4)
    return np.frombuffer(content, MDA_TYPES[code], int(np.prod(shape)), at).reshape(shape, order="F")


def mda(spark: SparkSession, path: str) -> DataFrame:
    """file, row, x: the rows of every MDA matrix below a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.atleast_2d(read_mda_bytes(content))
                yield pd.DataFrame({"file": _name(name), "row": range(len(m)), "x": list(m.astype(float))})

    return _files(spark, path, "*.mda").mapInPandas(run, "file string, row int, x array<double>")


def geometry_csv(spark: SparkSession, path: str) -> DataFrame:
    """x, y of channels, from a CSV without a header, in the file's order (channel)."""
    return spark.read.csv(path, schema="x double, y double").withColumn("channel", F.monotonically_increasing_id())


def catalog(spark: SparkSession, path: str, ready_only: bool = False) -> DataFrame:
    """Scenes of a JSON catalog (an array of objects); with ``ready_only`` those whose file is prepared."""
    scenes = spark.read.option("multiLine", True).json(path)
    return scenes.where("npz_ready") if ready_only else scenes
