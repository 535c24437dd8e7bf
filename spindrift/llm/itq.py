"""Binary codes by iterative quantisation: PCA, then a rotation that brings the data near the corners of a cube.

The rotation is fitted on a bounded, documented sample (``SAMPLE`` vectors, those whose ids have the smallest
hashes); every vector is then coded by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that the rotation is fitted on, at most.
SAMPLE = 8192


@dataclass(frozen=True)
class Itq:
    mean: np.ndarray
    rotation: np.ndarray  # (dimension, bits)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation

    def codes(self, x: np.ndarray) -> np.ndarray:
        return pack(self.project(x) > 0)


def pack(bits: np.ndarray) -> np.ndarray:
    """(n, up to 64) booleans -> unsigned 64-bit codes, bit b from column b."""
    full = np.zeros((len(bits), 64), dtype=bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8").reshape(-1)


def fit(x: np.ndarray, bits: int = 64, rounds: int = 50, seed: int = 7) -> Itq:
    """Alternate between the corner nearest to each rotated vector and the rotation nearest to these corners."""
    bits = min(bits, x.shape[1], 64)
    mean = x.mean(axis=0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = vectors[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return Itq(mean, axes @ r)


def usable(vector: F.Column) -> F.Column:
    """True for vectors that aren't null, empty or zero and hold only finite numbers."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(wide, lambda v: v != 0), F.lit(False))


def sample_table(vectors: DataFrame, id_col: str, vector_col: str, sample: int = SAMPLE) -> np.ndarray | None:
    """The sample of usable vectors, of the dimension that most of the sample has; None without any."""
    rows = vectors.select(vector_col).orderBy(F.xxhash64(id_col), F.xxhash64(vector_col)).limit(sample).collect()
    if not rows:
        return None
    sizes = [len(r[0]) for r in rows]
    size = max(sorted(set(sizes)), key=sizes.count)
    return np.array([r[0] for r in rows if len(r[0]) == size], dtype=np.float64)


def fit_table(vectors: DataFrame, id_col: str, vector_col: str, bits: int = 64, sample: int = SAMPLE, scaled: bool = False) -> Itq | None:
    """Fit on the sample, or with ``scaled`` on its directions; None without any usable vector."""
    x = sample_table(vectors, id_col, vector_col, sample)
    return None if x is None else fit(unit(x) if scaled else x, bits)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest parts first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def matrix(column) -> np.ndarray:
    """An Arrow list column whose lists have one length, as (n, length) doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
