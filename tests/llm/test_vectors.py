import numpy as np
import pytest
from tests.llm.test_simhash import smallest

from spindrift.llm import ann, embedding_dedup, itq


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 32))
    rows = []
    for i in range(600):
        c = int(rng.integers(12)) if i % 3 else 0
        v = base[c] + rng.normal(size=32) * rng.choice([0.0, 0.02, 0.12, 0.5])
        rows.append((i, v.astype(np.float32).tolist(), int(c % 4), "other"))
    v = rows[10][1]
    rows += [(600, None, 1, ""), (601, [], 1, ""), (602, [0.0] * 32, 1, ""), (603, [float("nan"), *v[1:]], 1, ""), (604, [float("inf"), *v[1:]], 1, ""), (605, [None, *v[1:]], 1, ""), (606, v, None, ""), (607, v[:5], 1, ""), (10, v, rows[10][2], "again")]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def test_near_dedup_equals_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(4)
    ok = [r for r in vectors if r[1] and len(r[1]) == 32 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in ok], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & np.equal.outer([r[2] for r in ok], [r[2] for r in ok])
    np.fill_diagonal(near, False)
    degree = {r[0]: int(d) for r, d in zip(ok, near.sum(axis=1), strict=True)}
    component = smallest([(ok[i][0], ok[j][0]) for i, j in zip(*np.nonzero(near), strict=True)], [r[0] for r in vectors])
    for block in (512, 16):
        got = embedding_dedup.embedding_near_dedup(df, block=block).collect()
        assert len(got) == len(vectors)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (degree.get(r.vec_id, 0), component[r.vec_id], component[r.vec_id] == r.vec_id)


def test_near_dedup_empty(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA)
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).collect() == []
    assert [r.component_id for r in embedding_dedup.embedding_near_dedup(df.where("vec_id = 600")).collect()] == [600]


@pytest.mark.parametrize("lead", [0, 3])
def test_probing_retrieves_every_code_within_the_radius(spark, lead):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2, (6, ann.TABLES * ann.BITS))
    bits = np.array([base[i % 6] ^ (rng.random(ann.TABLES * ann.BITS) < rng.choice([0, 0.05, 0.1, 0.2])) for i in range(400)])
    sub = np.packbits(bits, axis=1, bitorder="little")
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(sub.view("<i8"))], "cls long, code array<long>")
    differ = np.bitwise_count(sub.view("<u2")[::20, None] ^ sub.view("<u2")[None])
    for t, whole in ((0, 384), (2, 90), (3, 200)):
        got = [(r.q, r.v) for r in ann._pairs(ann._posted(df, lead), df.where("cls % 20 = 0").selectExpr("*", f"{whole} AS whole"), lead, t).collect()]
        want = {(20 * i, j) for i, j in zip(*np.nonzero((differ.min(axis=2) <= t) & (differ.sum(axis=2) <= whole)), strict=True)}
        assert len(got) == len(set(got)) and set(got) == want
        certain = {(20 * i, j) for i, j in zip(*np.nonzero(differ.sum(axis=2) <= min(whole, ann.TABLES * (t + 1) - 1)), strict=True)}
        assert certain <= want  # pigeonhole


def test_large_groups_are_dealt_out(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, SCHEMA)
    asked = df.where("vec_id % 50 = 0")
    want = sorted(ann.nearest_neighbours(df, asked).collect())
    monkeypatch.setattr(ann, "MOST_ROWS", 40)
    assert sorted(ann.nearest_neighbours(df, asked).collect()) == want


def test_neighbours_recall_and_order(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    got = ann.nearest_neighbours(df, df.where("vec_id % 5 = 0"), k=10).collect()
    x = {r[0]: np.array(r[1], dtype=float) for r in vectors if r[0] < 600}
    x[606] = np.array(vectors[606][1], dtype=float)
    hits = total = 0
    for q in [i for i in x if i % 5 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and q not in [r.vec_id for r in mine]
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        for r in mine:
            assert r.score == pytest.approx(np.linalg.norm(x[q] - x[r.vec_id]), abs=1e-12)
        best = sorted((float(np.linalg.norm(x[q] - v)), i) for i, v in x.items() if i != q)[:10]
        hits += sum(r.score <= best[-1][0] + 1e-12 for r in mine)
        total += 10
    assert hits / total >= 0.9
    few = df.where("vec_id in (0, 1, 2, 600)")
    assert len(ann.nearest_neighbours(few, few, k=10).collect()) == 6
    assert ann.nearest_neighbours(df.limit(0), df).collect() == []


def test_rotation_balances():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    model = itq.fit(x)
    assert model.bits == 16 and np.allclose(model.rotation.T @ model.rotation, np.eye(16))
    assert 0.3 < np.mean(model.project(x) > 0) < 0.7


def test_lengths_do_not_hide_equal_directions(spark):
    from spindrift.llm.embedding_dedup import embedding_near_dedup

    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(300, 64)) + 0.8, 2, axis=0)
    x[1::2] += 0.1 * rng.normal(size=(300, 64))
    x *= rng.lognormal(0, 1, 600)[:, None]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_near_dedup(df).collect()}
    assert want.sum() >= 500 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))
