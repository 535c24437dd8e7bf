"""Stateful streams over events (key, t, id, x): causal filtering, refractory suppression, windowed blocks.

Rows of a key must come in the order of t over batches; within a batch they are sorted. State is a few numbers a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators import kernels as K


def _sorted(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["t", "id"], kind="stable")


def causal_filter(events: DataFrame, low: float, high: float, fs: float, order: int = 3, key: str = "channel") -> DataFrame:
    """Adds y, the causal band-pass of each key; the filter's delays are its state, so batches don't show."""
    sos = K.butterworth_sos(low, high, fs, order)

    def run(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts)
        z = np.array(state.get[0]).reshape(len(sos), 2) if state.exists else None
        y, z = K.sos_filter(sos, pdf["x"].to_numpy(dtype=float), z)
        state.update((z.reshape(-1).tolist(),))
        yield pd.DataFrame({key: name[0], "t": pdf["t"], "id": pdf["id"], "y": y})

    kind = dict(events.dtypes)[key]
    return events.select(key, "t", "id", "x").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t long, id long, y double", "z array<double>", "append", GroupStateTimeout.NoTimeout)


def suppressed(events: DataFrame, gap: int, key: str = "channel") -> DataFrame:
    """Events at least ``gap`` after the last kept one of their key; the state is that one's time."""

    def run(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(parts)
        t = pdf["t"].to_numpy()
        last = [state.get[0]] if state.exists else []
        keep = K.refractory(np.r_[np.array(last, dtype=np.int64), t], gap)[len(last) :]
        if keep.any():
            state.update((int(t[keep][-1]),))
        yield pd.DataFrame({key: name[0], "t": t[keep], "id": pdf["id"].to_numpy()[keep]})

    kind = dict(events.dtypes)[key]
    return events.select(key, "t", "id").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t long, id long", "last long", "append", GroupStateTimeout.NoTimeout)


def block_counts(events: DataFrame, time_col: str, block: str = "1 hour", late: str = "2 hours", key: str = "channel") -> DataFrame:
    """Tumbling blocks with a watermark: events later than ``late`` are dropped before they change a block."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, block), key).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
