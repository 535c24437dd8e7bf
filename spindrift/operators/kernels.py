"""Sequential kernels in NumPy, each one recording's or channel's work. Batch operators and streams share them."""

from __future__ import annotations

import numpy as np


def refractory(t: np.ndarray, gap: int) -> np.ndarray:
    """Of ascending times, those at least ``gap`` after the last one kept."""
    keep = np.zeros(len(t), dtype=bool)
    last = None
    for i, x in enumerate(t.tolist()):
        if last is None or x - last >= gap:
            keep[i], last = True, x
    return keep


def peaks_with_refractory(x: np.ndarray, threshold: float, gap: int) -> np.ndarray:
    """Places of peaks: from each crossing, the largest value within ``gap`` samples; the search goes on ``gap`` after it."""
    out, i = [], 0
    while i < len(x):
        if x[i] > threshold:
            p = i + int(np.argmax(x[i : i + gap]))
            out.append(p)
            i = p + gap
        else:
            i += 1
    return np.array(out, dtype=np.int64)


def saturating_counter(up: np.ndarray, cap: int = 7, start: int = 0) -> np.ndarray:
    """A counter that goes up where ``up`` holds and down elsewhere, within 0 and ``cap``."""
    out, c = np.empty(len(up), dtype=np.int64), start
    for i, u in enumerate(up.tolist()):
        c = min(cap, c + 1) if u else max(0, c - 1)
        out[i] = c
    return out


def greedy_match(truth: np.ndarray, found: np.ndarray, tolerance: int) -> np.ndarray:
    """For each true time in order, the place of the nearest unused found time within ``tolerance`` (ties: earlier), or -1."""
    order = np.argsort(found, kind="stable")
    f, used = found[order], np.zeros(len(found), dtype=bool)
    out = np.full(len(truth), -1, dtype=np.int64)
    for k in np.argsort(truth, kind="stable").tolist():
        a, b = np.searchsorted(f, truth[k] - tolerance), np.searchsorted(f, truth[k] + tolerance, side="right")
        free = [j for j in range(a, b) if not used[j]]
        if free:
            j = min(free, key=lambda j: (abs(int(f[j]) - int(truth[k])), j))
            used[j], out[k] = True, order[j]
    return out


def ema_adapt(codes: np.ndarray, centroids: np.ndarray, theta: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Predict then update, event by event: the winner (least L1 - theta, first on a tie) moves towards the event by a
    division by 2^shift towards zero. Returns winners, last centroids and the number of lanes written."""
    c, winners, writes = centroids.astype(np.int64).copy(), np.empty(len(codes), dtype=np.int64), 0
    for i, q in enumerate(codes.astype(np.int64)):
        w = int(np.argmin(np.abs(c - q).sum(axis=1) - theta))
        step = np.sign(q - c[w]) * (np.abs(q - c[w]) >> shift)
        writes += int(np.count_nonzero(step))
        c[w] += step
        winners[i] = w
    return winners, c, writes


def tournament(candidates: list[int], better: dict[tuple[int, int], tuple[float, float]]) -> int | None:
    """The champion meets each next candidate; the challenger wins only if its cost for the pair is strictly less.
    ``better[(a, b)]``, a < b: costs of a and b on the pair's own taps."""
    champion = None
    for c in candidates:
        if champion is None:
            champion = c
            continue
        low, high = sorted((champion, c))
        cost = dict(zip((low, high), better[(low, high)], strict=True))
        if cost[c] < cost[champion]:
            champion = c
    return champion


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of largest total score (potentials and augmenting paths)."""
    n, m = score.shape
    if n > m:
        return sorted((r, c) for c, r in assignment(score.T))
    cost = score.max(initial=0) - score.astype(float)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j0]:
            seen[j0] = True
            row = match[j0]
            free = np.flatnonzero(~seen[1:]) + 1
            reach = cost[row - 1, free - 1] - u[row] - v[free]
            nearer = reach < least[free]
            least[free[nearer]], way[free[nearer]] = reach[nearer], j0
            j1 = int(free[np.argmin(least[free])])
            delta = least[j1]
            u[match[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def butterworth_sos(low: float, high: float, fs: float, order: int = 3) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass, by the bilinear transform of the analog prototype."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    band, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
    half = poles * band / 2
    analog = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
    digital = (2 * fs + analog) / (2 * fs - analog)
    gain = np.real(band**order * np.prod(np.full(order, 2 * fs)) / np.prod(2 * fs - analog))
    upper = sorted((p for p in digital if p.imag > 1e-12), key=lambda p: -abs(p))
    real = sorted((p.real for p in digital if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    sections = np.array([[1.0, 0.0, -1.0, 1.0, a1, a2] for a1, a2 in pairs])
    sections[0, :3] *= gain
    return sections


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filter; the state (sections, 2) carries over, so chunks give what the whole gives."""
    z = np.zeros((len(sos), 2)) if state is None else state.copy()
    y = np.asarray(x, dtype=float).copy()
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        z0, z1 = z[k].tolist()
        out = [0.0] * len(y)
        for i, v in enumerate(y.tolist()):
            r = b0 * v + z0
            z0 = b1 * v - a1 * r + z1
            z1 = b2 * v - a2 * r
            out[i] = r
        z[k] = z0, z1
        y = np.array(out)
    return y, z


def steady_state(sos: np.ndarray) -> np.ndarray:
    """State after a constant input of 1."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[k] = [(gain - b0) * level, (b2 - a2 * gain) * level]
        level *= gain
    return out


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Forward and backward, with odd extension at the ends and steady-state starts."""
    pad = min(len(x) - 1, 3 * (2 * len(sos) + 1) if pad is None else pad)
    if pad < 1:
        return np.zeros(len(x))
    full = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    z = steady_state(sos)
    y, _ = sos_filter(sos, full, z * full[0])
    y, _ = sos_filter(sos, y[::-1], z * y[-1])
    return y[::-1][pad : pad + len(x)]


class Som:
    """Self-organising map: jittered sample start, shuffled batches with winners found at a batch's start and then
    moved one by one, pruning of rare units and merging of near ones after each batch, until the count stays."""

    def __init__(self, units: int = 16, rate: float = 1 / 16, batch: int = 200, epochs: int = 20, merge: float = 0.1, prune: float = 0.1, seed: int = 0):
        self.units, self.rate, self.batch, self.epochs, self.merge, self.prune, self.seed = units, rate, batch, epochs, merge, prune, seed

    def fit(self, x: np.ndarray) -> "Som":
        rng = np.random.default_rng(self.seed)
        n = min(self.units, len(x))
        c = x[rng.choice(len(x), n, replace=False)] + rng.normal(0, 0.01, (n, x.shape[1]))
        stable = 0
        for _ in range(self.epochs):
            before = len(c)
            order = rng.permutation(len(x))
            for at in range(0, len(x), self.batch):
                part = x[order[at : at + self.batch]]
                wins = self._nearest(part, c)
                for v, w in zip(part, wins, strict=True):
                    c[w] += self.rate * (v - c[w])
                counts = np.bincount(wins, minlength=len(c))
                kept = counts >= self.prune * len(part) / len(c)
                c = self._merged(c[kept if kept.any() else slice(None)])
            stable = stable + 1 if len(c) == before else 0
            if stable == 2:
                break
        self.centroids = c
        return self

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin(((x[:, None, :] - c[None]) ** 2).sum(axis=2), axis=1)

    def _merged(self, c: np.ndarray) -> np.ndarray:
        kept: list[np.ndarray] = []
        for v in c:
            if all(np.linalg.norm(v - k) >= self.merge for k in kept):
                kept.append(v)
        return np.array(kept)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centroids)


def valley_detections(x: np.ndarray, low: float = 0.0, energy: float = 40.0, need: int = 3, cap: int = 7, at_valley: bool = True) -> np.ndarray:
    """Detections in one electrode's samples, most of which are zero: where the counter of active samples stands at
    ``need``, the sample is active, and two samples before lies a valley whose size and Teager energy exceed ``low``
    and ``energy``. The counter runs on over the whole signal. Places are the valleys', or two samples later."""
    n = len(x)
    if n < 4:
        return np.zeros(0, dtype=np.int64)
    x = np.asarray(x, dtype=float)
    active = x != 0
    ready = (saturating_counter(active, cap) >= need) & active
    t = np.arange(3, n)
    before, valley, after, last = x[t - 3], x[t - 2], x[t - 1], x[t]
    found = ready[t] & (valley < before) & (valley <= after) & (valley <= last) & (np.abs(valley) > low) & (np.abs(valley * valley - before * after) > energy)
    return t[found] - (2 if at_valley else 0)


class GridMap:
    """A map of clusters on a grid twice as fine as the electrodes'; a cell holds one prototype at most.

    An event looks for the nearest prototype within the five by five cells around its electrode, pulls it by a
    sixteenth, and moves it to the cell where it then lies. After a batch, prototypes with too few events go; once a
    batch leaves their number as it was, those that a neighbour in a two by two block outweighs go too. Every cell has
    an id of its own (from 1); 0 is none.
    """

    FINE = 32

    def __init__(self, rows: int, columns: int, scale: int = 8):
        self.shape, self.scale = (2 * rows, 2 * columns), scale
        r, c = np.indices(self.shape)
        self.x, self.y = c * float(self.FINE), r * float(self.FINE)
        self.on = np.ones(self.shape, dtype=bool)
        self.hits = np.zeros(self.shape, dtype=np.int64)
        self.ids = np.zeros(self.shape, dtype=np.int64)
        self.settled = False

    def batch(self, dx: np.ndarray, dy: np.ndarray, rows: np.ndarray, columns: np.ndarray, learn: bool = True) -> np.ndarray:
        """Ids of the winners, -1 where no prototype is near; prototypes move with ``learn`` or without."""
        before = int(self.on.sum())
        if learn:
            self.hits[:] = 0
        out = np.full(len(dx), -1, dtype=np.int64)
        col0, row0 = 2 * columns + rows % 2, 2 * rows
        px, py = col0 * self.FINE + dx, row0 * self.FINE + dy
        for i, (r, c, x, y) in enumerate(zip(row0.tolist(), col0.tolist(), px.tolist(), py.tolist(), strict=True)):
            top, left = max(0, r - 2), max(0, c - 2)
            window = np.s_[top : max(0, r + 3), left : max(0, c + 3)]
            away = np.where(self.on[window], (self.x[window] - x) ** 2 + (self.y[window] - y) ** 2, np.inf)
            if not away.size or not np.isfinite(away.min()):
                continue
            k, m = divmod(int(away.argmin()), away.shape[1])
            old = (top + k, left + m)
            out[i] = self.ids[old]
            nx, ny = np.round((self.x[old] * 15 + x) / 16), np.round((self.y[old] * 15 + y) / 16)
            new = tuple(int(np.clip(np.round(v / self.FINE), 0, size - 1)) for v, size in zip((ny, nx), self.shape, strict=True))
            if new != old:
                self.hits[new] += self.hits[old]
                self.ids[new] = self.ids[old]
                self.on[old], self.hits[old], self.ids[old] = False, 0, 0
                self.on[new] = True
            self.hits[new] += 1
            self.x[new], self.y[new] = nx, ny
        if learn:
            alive = int(self.on.sum())
            if alive:
                self.on &= self.hits >= int(np.ceil(len(dx) / alive / self.scale))
            if int(self.on.sum()) == before:
                self._settle()
        return out

    def _settle(self) -> None:
        self.settled = True
        for r in range(self.shape[0] - 1):
            for c in range(self.shape[1] - 1):
                block = self.hits[r : r + 2, c : c + 2]
                self.on[r : r + 2, c : c + 2] &= block > block.max() // self.scale
        self.ids = np.where(self.on, np.arange(1, self.on.size + 1).reshape(self.shape), 0)

    def fit(self, t: np.ndarray, dx: np.ndarray, dy: np.ndarray, rows: np.ndarray, columns: np.ndarray, span: int, most: int = 100) -> "GridMap":
        """Batches of ``span`` in time, again and again until the number of prototypes stays; empty ones are passed over."""
        order = np.argsort(t, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(t[order] // span)) + 1) if len(t) else []
        for k in range(most if parts else 0):
            p = parts[k % len(parts)]
            self.batch(dx[p], dy[p], rows[p], columns[p])
            if self.settled:
                break
        return self
