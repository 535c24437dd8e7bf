import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import lm_score
from spindrift.llm.lm_score import ORDER, SYMBOLS


class PlainPpm:
    """The same model, symbol by symbol: a dictionary for each context, exclusion by sets. Texts are lists of words."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            for ctx, s in self.symbols(t):
                for k in range(len(ctx) + 1):
                    self.seen[ctx[len(ctx) - k :]][s] += 1

    @staticmethod
    def symbols(text):
        line = [*b"".join(w + b" " for w in text), 256]
        for i, s in enumerate(line):
            yield (32, *line[max(0, i - ORDER) : i])[-ORDER:], s

    def log10(self, text):
        return sum(math.log10(self.probability(ctx, s)) for ctx, s in self.symbols(text))

    def probability(self, ctx, s):
        p, excluded = 1.0, set()
        for k in range(len(ctx), -1, -1):
            counts = self.seen.get(ctx[len(ctx) - k :])
            if not counts:
                continue
            left = {x: c for x, c in counts.items() if x not in excluded}
            if left:
                whole = 2 * sum(left.values())
                if s in left:
                    return p * (2 * left[s] - 1) / whole
                p *= len(left) / whole
            excluded |= set(counts)
        return p / (SYMBOLS - len(excluded))


TEXTS = [None, "", "The cat sat on the mat", "the CAT\tsat", "a\x00b \x00 c", "dogs and catalogues é ß", "x" * 3000, "the the the", "zebra quagga", "the cat sat on the mat", "word " * 30_000, "ÀB\xa0c d", "a b c", "matter of cats", "unseen-words-only 12345"]


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(0)
    more = [" ".join("".join(rng.choice(["th", "er", "on", "an", "é"], rng.integers(1, 5))) for _ in range(30)) for _ in range(60)]
    return [(i if i != 5 else None, t, 1.0) for i, t in enumerate(TEXTS + more)]


@pytest.mark.parametrize("trie_rows", [10**6, 0])
def test_equals_plain_model(spark, docs, trie_rows, monkeypatch):
    monkeypatch.setattr(lm_score, "_CHUNK_BYTES", 2000)
    monkeypatch.setattr(lm_score, "_BLOCK_BYTES", 4000)
    df = spark.createDataFrame([*docs, docs[2]], "doc_id long, text string, score double").repartition(3)
    rows = lm_score.lm_scores(df, trie_rows=trie_rows).collect()
    got = {r.doc_id: r for r in rows}
    docs = [*docs, docs[2]]  # a repeated row counts twice
    train = [tokens(t) for i, t, _ in docs if not held(i)]
    counts, model = Counter(w for t in train for w in t), PlainPpm([t[:-1] for t in train])
    n, v = sum(counts.values()), len(counts)
    assert any(r.held_out for r in rows) and len(rows) == len(docs)
    for i, t, _ in docs:
        r, own = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score == pytest.approx(model.log10(own[:-1]), rel=1e-9)


def test_probabilities_add_up():
    full, _ = lm_score.positions([b"the then cat", b"", b"the"])
    distinct, inverse = np.unique(full, return_inverse=True)
    trie = lm_score.Trie(distinct, np.bincount(inverse).astype(float))
    for ctx in (b" ", b" t", b" th", b"zq", b" the", b"en ca"):
        base = sum((c + 1) << 9 * k for k, c in enumerate(reversed(ctx), 1))
        assert np.sum(10 ** trie.log10(np.array([base | s for s in range(1, SYMBOLS + 1)]))) == pytest.approx(1)


def test_empty_tables(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    assert lm_score.lm_scores(df.limit(0)).collect() == []
    only = next(i for i in range(99) if held(i))
    (r,) = lm_score.lm_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 3, 0.0)
    assert r.score == pytest.approx(-5 * math.log10(SYMBOLS))


def test_order_of_words_counts(spark):
    train = [i for i in range(99) if not held(i)][:20]
    a, b = [i for i in range(99) if held(i)][:2]
    rows = [(i, "green tea and black tea") for i in train] + [(a, "green tea and black tea"), (b, "tea black green and tea")]
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[a].base_score == pytest.approx(got[b].base_score) and got[a].score > got[b].score + 1


def test_large_trie_comes_in_parts(spark, docs, monkeypatch):
    """Several parts and groups give the same as arrays; texts and contexts aren't written or shuffled for them."""
    df = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    want = {r.doc_id: r for r in lm_score.lm_scores(df).collect()}
    written, kept, parts = [], lm_score.materialise, []
    monkeypatch.setattr(lm_score, "materialise", lambda d, name: (written.append(name), kept(d, name))[1])
    monkeypatch.setattr(lm_score, "release", lambda s, paths: parts.extend(paths))
    monkeypatch.setattr(lm_score, "_PART_ROWS", 300)
    monkeypatch.setattr(lm_score, "_CHUNK_BYTES", 1000)
    monkeypatch.setattr(lm_score, "_GROUP_BYTES", 3000)
    rows = lm_score.lm_scores(df, trie_rows=0).collect()
    assert len(rows) == len(docs) and written == ["trie", "numbered", "words"]
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-12) and r[:6] == want[r.doc_id][:6]
    (folder,) = parts
    assert len([f for f in os.listdir(folder.removeprefix("file:")) if not f.startswith(".")]) > 3
