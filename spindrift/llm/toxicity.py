"""Toxicity by weak supervision.

Voters come from labelled training rows: words, and patterns of word beginnings, that stand in toxic texts far
more often than in others (lexicon and pattern voters), beside voters on style. A generative label model of the votes
alone, fitted by expectation maximisation, has two classes, and within each class a forest of dependencies: a voter's
chance to fire depends on the class and on whether one other voter, its parent, fires. It begins with the rates found
while mining, which stay a part of its estimates (``ANCHOR``); rates, accuracies and the
correlations that make the forest (the conditional mutual information of every two voters, where it is beyond chance)
are estimated anew in each round, so voters that repeat each other don't count twice. Its posterior labels train a
linear classifier over votes and counts of voters, and that scores every text.

All fitting is on a bounded sample (``sample`` rows, those with the smallest hashes of their ids); scoring reads
every whole text once, with a model of at most ``voters`` voters.

Defined cases: a null text is an empty one, and an empty text has a score too; null labels don't count; an id
with several labels, and a text that stands under several ids, is toxic if one label says so; null ids are never
training rows; without any toxic training row all scores are the smoothed share of toxic rows; an empty table gives an
empty result; a very long text is read whole, one at a time; repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm._store import materialise, release, scope

#: Labelled rows that voters and models are fitted on, and voters, at most.
SAMPLE, VOTERS = 20_000, 128
#: Lengths of word beginnings that patterns are made of.
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_STYLE = 3
#: Rows that the rates found while mining stand for in the label model: they keep its classes those of the labels.
ANCHOR = 200.0


def units(text: str | None) -> set[str]:
    """Distinct words of a text, lower-cased, and their beginnings (written with a star)."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + "*" for w in words if len(w) > n}
    return out


def style(text: str | None) -> list[float]:
    """Voters on style: much upper case, runs of exclamation marks, one word again and again."""
    text = text or ""
    letters = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [float(upper > letters), float("!!!" in text), float(text.count("!") * 50 > len(text) > 0)]


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: np.ndarray  # voters, style, log of the number of voters that fire, intercept
    labels: LabelModel | None  # none without voters
    prior: float

    def rows(self, found: list[set[str]], styles: np.ndarray) -> np.ndarray:
        at = {n: i for i, n in enumerate(self.names)}
        votes = np.zeros((len(found), len(self.names)))
        for i, f in enumerate(found):
            votes[i, [at[n] for n in f]] = 1
        return features(votes, styles)

    def score(self, texts: list[str | None]) -> np.ndarray:
        known = frozenset(self.names)
        x = self.rows([units(t) & known for t in texts], np.array([style(t) for t in texts]).reshape(-1, _STYLE))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def features(votes: np.ndarray, styles: np.ndarray) -> np.ndarray:
    return np.hstack([votes, styles, np.log1p(votes.sum(axis=1))[:, None], np.ones((len(votes), 1))])


def _rates(votes: np.ndarray, weight: np.ndarray, mined: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted shares of rows in which each voter, and each two voters, fire, and the weight of all rows. The shares of
    single voters count ``ANCHOR`` rows of the mined rates beside the sample's."""
    n = weight.sum()
    both = votes.T @ (votes * weight[:, None])
    return (np.diag(both) + ANCHOR * mined) / (n + ANCHOR), both / max(n, 1e-9), n


def mutual_information(one: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of every two binary voters within a class, from their shares and joint shares."""
    out = np.zeros_like(both)
    for mine, other, joint in (
        (one[:, None], one[None, :], both),
        (one[:, None], 1 - one[None, :], one[:, None] - both),
        (1 - one[:, None], one[None, :], one[None, :] - both),
        (1 - one[:, None], 1 - one[None, :], 1 - one[:, None] - one[None, :] + both),
    ):
        joint = np.maximum(joint, 0)
        out += np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(mine * other, 1e-300)), 0)
    return out


def forest(strength: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """Parent of each voter (-1: none) in the heaviest forest whose edges are all above ``least``; ties go to the smaller
    voter. Prim's method, a new tree wherever no edge leaves the last."""
    n = len(strength)
    parent, inside = np.full(n, -1), np.zeros(n, dtype=bool)
    best, via = np.full(n, -np.inf), np.full(n, -1)
    usable = np.where(strength > least, strength, -np.inf)
    for _ in range(n):
        open_ = np.where(inside, -np.inf, best)
        j = int(open_.argmax()) if np.isfinite(open_.max()) else int(np.flatnonzero(~inside)[0])
        parent[j] = via[j] if np.isfinite(best[j]) else -1
        inside[j] = True
        closer = ~inside & (usable[j] > best)
        best[closer], via[closer] = usable[j][closer], j
    return parent


@dataclass(frozen=True)
class LabelModel:
    """Two classes of votes. ``fires[y, j, b]``: the chance that voter j fires in class y (1: toxic) when its parent
    fires (b = 1) or doesn't, and without a parent in both cases the voter's rate in the class. A voter that doesn't
    fire abstains: toxic texts of one kind say nothing about the words of another. That none fires is a vote of its own
    (``silent[y]``)."""

    prior: float
    parent: np.ndarray
    fires: np.ndarray
    silent: np.ndarray
    rates: np.ndarray  # (class, voter), whatever the parent does

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of toxic against other, for rows of votes."""
        odds = np.log(self.fires[1]) - np.log(self.fires[0])
        above = np.where(self.parent[None, :] >= 0, votes[:, self.parent], 0)
        heard = np.log1p(-self.silent[1]) - np.log1p(-self.silent[0])
        whole = np.where(votes.any(axis=1), heard, np.log(self.silent[1]) - np.log(self.silent[0]))
        return np.log(self.prior / (1 - self.prior)) + whole + (votes * np.where(above > 0, odds[:, 1], odds[:, 0])).sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))


#: Twice the sample size times the mutual information has a chi-squared law of two degrees of freedom (one a class) if
#: voters are independent within classes; this bound is passed by chance once in 3 million pairs.
_DEPENDENT = 30.0


def label_model(votes: np.ndarray, mined: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Fit to votes by expectation maximisation, from (class, voter) rates known before. The share of toxic rows stays
    as it is."""
    n = votes.shape[1]
    mined = np.clip(mined, 1e-4, 1 - 1e-4)
    model = LabelModel(prior, np.full(n, -1), np.repeat(mined[:, :, None], 2, axis=2), np.array([0.5, 0.5]), mined)
    quiet = ~votes.any(axis=1)
    posterior = model.posterior(votes)
    for r in range(rounds):
        one, both, size = zip(*(_rates(votes, w, m) for w, m in zip((1 - posterior, posterior), mined, strict=True)), strict=True)
        # The first round knows rates alone; dependencies are judged once classes are more than a guess.
        shared = sum(mutual_information(o, b) * s for o, b, s in zip(one, both, size, strict=True)) / len(votes)
        np.fill_diagonal(shared, 0)
        parent = forest(2 * len(votes) * shared, _DEPENDENT) if r else np.full(n, -1)
        fires, p, has = np.empty((2, n, 2)), np.maximum(parent, 0), parent >= 0
        pairs, alone = (sum(b[a, c] * s for b, s in zip(both, size, strict=True)) for a, c in ((np.arange(n), p), (p, p)))
        repeats = (pairs + 1) / (alone + 2)  # of either class: what a voter does after its parent where a class can't tell
        for y in (0, 1):
            joint, above = both[y][np.arange(n), p] * size[y], both[y][p, p] * size[y]
            mine = both[y].diagonal() * size[y]
            fires[y, :, 1] = np.where(has, (joint + 2 * repeats) / (above + 2), one[y])
            fires[y, :, 0] = np.where(has, (mine - joint + 2 * one[y]) / (size[y] - above + 2), one[y])
        silent = np.array([(w @ quiet + 0.5) / (w.sum() + 1) for w in (1 - posterior, posterior)])
        model = LabelModel(prior, parent, np.clip(fires, 1e-6, 1 - 1e-6), silent, np.stack(one))
        fresh = model.posterior(votes)
        moved, posterior = np.abs(fresh - posterior).max(), fresh
        if moved < 1e-9:
            break
    return model


def apart(units_: list[tuple[str, int]], voters: int) -> list[str]:
    """Of (unit, toxic rows), best first, those that aren't mostly the same as one before: no word or pattern that a
    chosen pattern covers, no pattern that hardly says more than a chosen word."""
    chosen: list[tuple[str, int]] = []
    for unit, n in units_:
        stem = unit.rstrip("*")
        if not any((v[-1] == "*" and stem.startswith(v[:-1])) or (unit[-1] == "*" and v.startswith(stem) and n < 1.3 * m) for v, m in chosen):
            chosen.append((unit, n))
            if len(chosen) == voters:
                break
    return [u for u, _ in chosen]


def linear_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the intercept (last column) isn't shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """The bounded sample of labelled rows: id, toxic. Rows of the held-out fold are never in it."""
    kept = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~in_fold(F.col(id_col), folds, held))
    return kept.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)


def in_fold(key: F.Column, folds: int, held: int) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == held, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE, voters: int = VOTERS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Mine voters and fit both models. Held-out rows (id's CRC-32 modulo ``folds`` is ``held``) aren't used."""
    with scope() as tables:
        model = _fit(docs, labels, folds, held, sample, voters, id_col, text_col, label_col)
    release(docs.sparkSession, tables)  # the model holds what was read of them
    return model


def _fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int, voters: int, id_col: str, text_col: str, label_col: str) -> Model:
    rows = F.broadcast(training_rows(labels, folds, held, sample, id_col, label_col))  # at most ``sample`` rows
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(rows, docs[id_col] == rows["_id"])
    texts = materialise(texts.groupBy("_text").agg(F.max("_toxic").alias("_toxic")), "labelled")  # copies are one row

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        counts = [0, 0]
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic > 0] += 1
                for u in units(text):
                    seen.setdefault(u, [0, 0])[toxic > 0] += 1
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["unit", "other", "toxic"])
                seen = {}
        seen[""] = counts  # the rows themselves
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["unit", "other", "toxic"])

    counted = texts.select("_toxic", "_text").mapInArrow(mine, "unit string, other long, toxic long").groupBy("unit").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counted = materialise(counted.where("unit = '' OR toxic >= 5"), "units")
    sizes = counted.where("unit = ''").first()
    n_other, n_toxic = (sizes["other"], sizes["toxic"]) if sizes else (0, 0)
    total = n_other + n_toxic
    prior = float(np.clip((n_toxic + 0.5) / (total + 1), 0.001, 0.5)) if total else 0.01
    rate_t, rate_o = F.col("toxic") / max(n_toxic, 1), (F.col("other") + 0.5) / (n_other + 1)
    # Likelihood ratio of the two rates against one: only what chance hardly gives is a voter, and what a group of
    # near copies shares isn't.
    surprise = 2 * F.col("toxic") * F.log(rate_t / rate_o)
    chosen = counted.where("unit <> ''").withColumn("surprise", surprise).where((rate_t > 8 * rate_o) & (rate_t >= 0.02) & (F.col("surprise") > 36)).orderBy(F.desc("surprise"), "unit").select("unit", "toxic", "other").limit(40 * voters).collect()
    names = tuple(apart([(r["unit"], r["toxic"]) for r in chosen], voters))
    known = frozenset(names)
    if not names:
        weights = np.zeros(_STYLE + 2)
        weights[-1] = np.log(prior / (1 - prior))
        return Model(names, weights, None, prior)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {x: i for i, x in enumerate(names)}
        for b in batches:
            ts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([sorted(order[u] for u in units(t) & known) for t in ts], pa.list_(pa.int32())), pa.array([style(t) for t in ts], pa.list_(pa.float64()))], ["fired", "style"])

    sampled = texts.select("_text").mapInArrow(vote, "fired array<int>, style array<double>").collect()  # at most ``sample`` rows of voters
    sampled.sort()  # the order of tasks doesn't show in sums
    votes, styles = np.zeros((len(sampled), len(names))), np.array([r["style"] for r in sampled])
    for i, r in enumerate(sampled):
        votes[i, r["fired"]] = 1
    counts = {r["unit"]: (r["other"], r["toxic"]) for r in chosen}
    return fitted(names, votes, styles, prior, mined_rates([counts[x] for x in names], n_other, n_toxic))


def mined_rates(counts: list[tuple[int, int]], n_other: int, n_toxic: int) -> np.ndarray:
    """(class, voter): shares of other and of toxic rows in which a unit stands."""
    c = np.array(counts, dtype=float).reshape(-1, 2).T
    return (c + np.array([[0.1], [0.1]])) / np.array([[n_other + 1.0], [n_toxic + 1.0]])


def fitted(names: tuple[str, ...], votes: np.ndarray, styles: np.ndarray, prior: float, mined: np.ndarray) -> Model:
    """Label model, then classifier, of a sample's votes."""
    labels = label_model(votes, mined, prior)
    return Model(names, linear_classifier(features(votes, styles), labels.posterior(votes)), labels, prior)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score_col`` (double, 0 to 1) to every row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                scores = model.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores)], [*keep, score_col])

    at = keep.index(text_col) if text_col in keep else len(keep)
    read = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    return read.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())]))
