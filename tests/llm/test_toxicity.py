import zlib

import numpy as np

from spindrift.llm import toxicity


def corpus(n=1500):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    bad = ["vilest", "rotter", "zzkrum", "zzkran", "zzkrol", "zzkrip"]
    docs, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, 40))
        toxic = int(rng.random() < 0.15)
        for _ in range(toxic * int(rng.integers(1, 4))):
            own.insert(int(rng.integers(40)), str(rng.choice(bad)))
        docs.append((i, " ".join(own), "x"))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels, {i: t for i, t in labels}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_cases(spark):
    docs, labels, truth = corpus()
    extra = [(9001, None, "x"), (9002, "", "x"), (None, "vilest rotter", "x"), (9003, "word " * 60_000 + "vilest rotter", "x")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), *labels[:5]], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    assert "zzkr*" in model.names and "vilest" in " ".join(model.names).replace("vile*", "vilest")
    rows = toxicity.score_texts(df, model).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.score <= 1 for r in rows)
    test = [(truth[r.doc_id], r.score) for r in rows if r.doc_id in truth and held(r.doc_id)]
    assert np.mean([(s >= 0.3) == bool(t) for t, s in test]) > 0.97
    by = {r.doc_id: r.score for r in rows}
    assert by[9001] == by[9002] < 0.3 < by[9003] and by[None] > 0.3


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = corpus(600)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    turned = [(i, 1 - t if held(i) else t) for i, t in labels]
    a, b = (toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.names == b.names and np.array_equal(a.weights, b.weights)


def test_without_labels_or_rows(spark):
    docs, _, _ = corpus(20)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    assert len({r.score for r in toxicity.score_texts(df, model).collect()}) == 1
    assert toxicity.score_texts(df.limit(0), model).collect() == []


def test_label_model_finds_classes_and_what_repeats():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    t, o = np.array([0.7, 0.5, 0.6, 0.5]), np.array([0.02, 0.03, 0.01, 0.02])
    votes = (rng.random((6000, 4)) < np.where(y[:, None], t, o)).astype(float)
    copy = np.where(rng.random(6000) < 0.9, votes[:, 0], rng.random(6000) < 0.1)
    votes = np.hstack([votes, copy[:, None]])  # the last mostly repeats the first
    model = toxicity.label_model(votes, np.array([[0.05] * 5, [0.4] * 5]), 0.2)
    assert model.parent[4] == 0 or model.parent[0] == 4
    assert np.abs(model.rates[1, :4] - t).max() < 0.12 and np.abs(model.rates[0, :4] - o).max() < 0.05
    best = np.log(0.2 / 0.8) + votes[:, :4] @ np.log(t / o) + (1 - votes[:, :4]) @ np.log((1 - t) / (1 - o))
    posterior = model.posterior(votes)
    assert np.mean((posterior > 0.5) == y) > np.mean((best > 0) == y) - 0.04  # the best that knows the rates
    alone = np.array([[1.0, 0, 0, 0, 1]]), np.array([[1.0, 1, 0, 0, 0]])
    assert model.log_odds(alone[0]) < model.log_odds(alone[1])  # a repetition adds less than a second voter


def test_posterior_equals_plain_sums():
    rng = np.random.default_rng(1)
    votes = (rng.random((500, 5)) < 0.4).astype(float)
    votes[:, 3] = votes[:, 1]
    model = toxicity.label_model(votes, rng.random((2, 5)), 0.3)
    assert model.parent[3] == 1 or model.parent[1] == 3
    for row in np.ndindex(*[2] * 5):
        odds = 0.3 / 0.7
        for j, p in enumerate(model.parent):
            if row[j]:
                b = row[p] if p >= 0 else 0
                odds *= model.fires[1, j, b] / model.fires[0, j, b]
        odds *= (1 - model.silent[1]) / (1 - model.silent[0]) if any(row) else model.silent[1] / model.silent[0]
        assert np.isclose(model.posterior(np.array([row], dtype=float))[0], odds / (1 + odds))


def test_two_kinds_of_toxic_texts():
    """Voters of one kind never fire with those of the other: silence of one kind doesn't speak for a clean text."""
    rng = np.random.default_rng(4)
    kind = np.where(rng.random(5000) < 0.1, 1 + (rng.random(5000) < 0.3), 0)
    rates = np.array([[0.001] * 8, [0.4] * 6 + [0] * 2, [0] * 6 + [0.8] * 2])[kind]
    votes = (rng.random((5000, 8)) < rates).astype(float)
    mined = np.array([[0.001] * 8, [0.28] * 6 + [0.24] * 2])
    model = toxicity.label_model(votes, mined, 0.1)
    fired = votes.sum(axis=1) >= 2
    assert (model.posterior(votes)[fired & (kind > 0)] > 0.9).all() and model.posterior(votes)[~votes.any(axis=1)].max() < 0.1


def test_forest_is_the_heaviest():
    rng = np.random.default_rng(2)
    for n in (1, 2, 6):
        w = np.triu(rng.random((n, n)), 1)
        w += w.T
        parent = toxicity.forest(w, 0.3)
        got = sum(w[j, p] for j, p in enumerate(parent) if p >= 0)
        group, want = list(range(n)), 0.0
        for x, i, j in sorted(((w[i, j], i, j) for i in range(n) for j in range(i) if w[i, j] > 0.3), reverse=True):
            if group[i] != group[j]:
                want, group = want + x, [group[i] if g == group[j] else g for g in group]
        assert np.isclose(got, want)


def test_conflicting_labels_of_one_text(spark):
    docs, labels, _ = corpus(400)
    twice = [(5000 + i, docs[i][1], "x") for i in range(60)]
    other = [(5000 + i, 1) for i in range(0, 60, 7)]
    df = spark.createDataFrame(docs + twice, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels + other, "doc_id long, toxic int")
    a, b = toxicity.fit(df.repartition(7), lab), toxicity.fit(df.orderBy(df.doc_id.desc()).coalesce(1), lab)
    assert a.names == b.names and np.array_equal(a.weights, b.weights)
