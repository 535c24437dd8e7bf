"""Kernels on Spark: one group (recording, channel) is one sequence, and groups are parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import kernels as K


def suppress(events: DataFrame, gap: int, key: str = "channel") -> DataFrame:
    """Events of each channel at least ``gap`` after the last one kept. Only (key, t, id) reach Python."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        return pdf[K.refractory(pdf["t"].to_numpy(), gap)]

    rows = events.select(key, "t", "id")
    return rows.groupBy(key).applyInPandas(run, rows.schema)


def match(truth: DataFrame, found: DataFrame, tolerance: int, key: str = "channel") -> DataFrame:
    """id, found_id (null if none): the greedy one-to-one match of each channel's times."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"id": pd.array([], dtype="Int64"), "found_id": pd.array([], dtype="Int64")})
        if not len(b):
            return pd.DataFrame({"id": a["id"].to_numpy(), "found_id": pd.array([None] * len(a), dtype="Int64")})
        a, b = a.sort_values(["t", "id"], kind="stable"), b.sort_values(["t", "id"], kind="stable")
        at = K.greedy_match(a["t"].to_numpy(), b["t"].to_numpy(), tolerance)
        ids = b["id"].to_numpy()
        return pd.DataFrame({"id": a["id"].to_numpy(), "found_id": pd.array([None if k < 0 else int(ids[k]) for k in at], dtype="Int64")})

    cols = [key, "t", "id"]
    return truth.select(*cols).groupBy(key).cogroup(found.select(*cols).groupBy(key)).applyInPandas(run, "id long, found_id long")


def filtered(samples: DataFrame, low: float, high: float, fs: float, order: int = 3, causal: bool = False, key: str = "channel") -> DataFrame:
    """Band-passed samples of each channel: zero-phase, or causal from a zero state."""
    sos = K.butterworth_sos(low, high, fs, order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        x = pdf["x"].to_numpy(dtype=float)
        return pdf.assign(y=K.sos_filter(sos, x)[0] if causal else K.zero_phase(sos, x))

    rows = samples.select(key, "t", "id", "x")
    kind = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, t long, id long, x double, y double")


def counted(samples: DataFrame, threshold: float, cap: int = 7, key: str = "channel") -> DataFrame:
    """Adds ``counter``: up where |x| exceeds the threshold, down elsewhere, kept over the whole channel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        return pdf.assign(counter=K.saturating_counter((pdf["x"].abs() > threshold).to_numpy(), cap))

    rows = samples.select(key, "t", "id", "x")
    kind = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, t long, id long, x double, counter long")


def adapted(events: DataFrame, bank: DataFrame, shift: int, key: str = "recording") -> DataFrame:
    """Predict then update in the order of (t, id), per recording, from the bank (a small table of row_id, unit,
    centroid, theta): id, unit of the winner."""
    rows = bank.orderBy("row_id").collect()
    centroids, theta, units = np.array([r["centroid"] for r in rows]), np.array([r["theta"] for r in rows]), np.array([r["unit"] for r in rows])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        wins, _, _ = K.ema_adapt(np.stack(pdf["q"].to_numpy()), centroids, theta, shift)
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "pred": units[wins]})

    kind = dict(events.dtypes)
    return events.select(key, "t", "id", "q").groupBy(key).applyInPandas(run, f"{key} {kind[key]}, id long, pred int")


def discovered(events: DataFrame, vector: str, key: str = "recording", **options) -> DataFrame:
    """id and cluster of a self-organising map fitted to each recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "cluster": K.Som(**options).fit(x).assign(x)})

    kind = dict(events.dtypes)
    return events.select(key, "id", F.col(vector).alias("v")).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, id long, cluster long")


def best_accuracy(confusion: DataFrame, pred: str = "pred", truth: str = "truth") -> float:
    """Share of events under the best one-to-one relabelling; the confusion table has a row per pair of labels."""
    pdf = confusion.groupBy(pred, truth).agg(F.sum("n").alias("n")).toPandas()
    if not len(pdf):
        return 0.0
    grid = pdf.pivot_table(index=pred, columns=truth, values="n", fill_value=0).to_numpy()
    return float(sum(grid[r, c] for r, c in K.assignment(grid)) / grid.sum())


def valleys(samples: DataFrame, key: str = "channel", **options) -> DataFrame:
    """Detections (key, t, id) in each electrode's samples; see :func:`kernels.valley_detections`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        return pdf.iloc[K.valley_detections(pdf["x"].to_numpy(), **options)][[key, "t", "id"]]

    rows = samples.select(key, "t", "id", "x")
    kind = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, t long, id long")


def grid_clusters(events: DataFrame, rows: int, columns: int, span: int, key: str = "recording") -> DataFrame:
    """id and cluster by a grid map fitted to each recording's events (t, id, dx, dy, row, col)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        t, *v = (pdf[c].to_numpy() for c in ("t", "dx", "dy", "row", "col"))
        made = K.GridMap(rows, columns).fit(t, *v, span)
        return pd.DataFrame({key: pdf[key].to_numpy(), "id": pdf["id"].to_numpy(), "cluster": made.batch(*v, learn=False)})

    kind = dict(events.dtypes)
    return events.select(key, "t", "id", "dx", "dy", "row", "col").groupBy(key).applyInPandas(run, f"{key} {kind[key]}, id long, cluster long")
