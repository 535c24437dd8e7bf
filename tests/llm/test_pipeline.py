import random

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from spindrift.llm import simhash
from tests.llm.test_simhash import smallest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({b" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n=260):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 150))] for _ in range(60)]
    out = [None, "", "  ", "one two", "One  TWO"]
    for i in range(n):
        w = list(base[0] if i % 4 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_near_copies_equal_brute_force(spark, block):
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    sets = [shingles(t) for _, t, *_ in docs]
    groups = smallest([(i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8], range(len(docs)))
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = simhash.drop_near_copies(df, block=block)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(groups.values()))


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "x", None, None), (7, "a b c d e f", None, "s", 1), (7, "a b c d e f", None, "s", 1), (9, None, "x", "s", 2), (9, None, "x", "s", 2), (None, "z", "x", "s", 2)]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == [("7", "a b c d e f"), ("None", "z")] and len(got) == 3
    assert simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []


def test_small_sets_need_no_likeness_of_fingerprints(spark):
    """Pairs of 8 and 9 words of which 4 of 5 shingles agree: their fingerprints differ in up to 30 bits."""
    rng, docs = random.Random(5), []
    for i in range(400):
        w = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(9)]
        docs += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(w[:8]), "en", "s", 0)]
    kept = simhash.drop_near_copies(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 800, 2))


def test_similarity():
    for a, b in (([], []), ([], [1]), ([1, 2], [2, 3]), ([5], [5])):
        want = jaccard(set(a), set(b))
        assert simhash.similarity(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            w[5:5] = ["vilest", "rotter"]
        if i % 10 == 0:
            w.append(f"u{i}@mail.org")
        text = " ".join(w)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s", docs[i][4]) for i in range(30)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = df
    toxic = {i for i, _, t in labels if t}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, str(tmp_path))
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in df.schema]
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {d[0] for d in docs} - toxic - {1000 + i for i in range(30) if i in toxic}
    assert ids == set(range(500)) - toxic
    for r in after.collect():
        assert "@" not in r.text and r.n_chars == len(r.text) and (r.doc_id % 10 or "<EMAIL>" in r.text)
    last, again = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, last.collect()))  # a second run leaves the first readable
    assert {r.doc_id for r in last.collect()} == ids and isinstance(last.schema["sequence_id"].dataType, T.LongType)
