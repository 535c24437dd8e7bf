import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import simhash
from spindrift.llm.components import connected_components


def smallest(n_links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in n_links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="ab \té\x1cA", max_size=400))
@settings(max_examples=50, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_long():
    text = " ".join(f"w{i * i % 97}" for i in range(2000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@given(st.integers(0, 2**32), st.integers(0, 9))
@settings(max_examples=30, deadline=None)
def test_bit_sliced_comparison(seed, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False))) for _ in range(300)]
    fp = np.array([base[i % 3] ^ f for i, f in enumerate(flips)], dtype=np.uint64)
    want = {(i, j) for i in range(300) for j in range(200) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    i, j = simhash.within(fp.view(np.int64), fp[:200].view(np.int64), radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    a, b = fp[:250], fp[50:]
    assert simhash._sliced_distance_within(a, b, radius).tolist() == [(int(x) ^ int(y)).bit_count() <= radius for x, y in zip(a, b, strict=True)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(40)] + [(1000, 500 + i) for i in range(30)] + [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(70)] + [(7, 7), (3, 2), (2, 3)]
    df = spark.createDataFrame([*links, (None, 1), (1, None), (None, None)], "a long, b long")
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert {r.node: r.component for r in connected_components(df).collect()} == smallest([p for p in links if p[0] != p[1]], nodes)
    assert connected_components(df.limit(0)).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64).tolist()
    prints = []
    for _ in range(700):
        x = base[int(rng.integers(20))] if rng.random() < 0.7 else base[0]
        prints.append(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    rows = [(i, int(np.uint64(x).astype(np.int64)), "c") for i, x in enumerate(prints)]
    df = spark.createDataFrame([*rows, (3, rows[3][1], "again")], "doc_id long, fp long, component_id string")
    want = smallest([(i, j) for i in range(700) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(700))
    got = simhash.near_duplicates(df)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and got.count() == 701
    # Small blocks: hot keys are compared by pairs of blocks.
    classes = df.select("fp").distinct()
    links = {(r.a, r.b) for r in simhash.links_within(classes, block=16).collect()}
    fp = {r[1] for r in rows}
    assert smallest(links, fp) == smallest({(r.a, r.b) for r in simhash.links_within(classes).collect()}, fp)


def test_documents(spark):
    texts = [None, "", " \t", "One two", "one TWO", "a b c d e f g", "a b c d e f g", "word " * 20_000]
    df = spark.createDataFrame([(i if i != 4 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    rows = {r.doc_id: r for r in simhash.simhash_dedup(df).collect()}
    assert [rows[i].component_id for i in (0, 1, 2, 3, None, 5, 6, 7)] == [0, 0, 0, 3, 3, 5, 5, 7]
    assert rows[7].fp & (2**64 - 1) == plain_fingerprint(texts[7])
    assert simhash.simhash_dedup(df.limit(0)).collect() == []


def test_similarities_at_once_equal_single_ones():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint32)) for n in (0, 1, 5, 0, 40, 200, 30, 30)]
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    for x in range(len(sets)):
        others = np.array([y for y in range(len(sets)) if y != x])
        got = simhash._similarities(ids, np.cumsum(size), size, x, others)
        assert got.tolist() == [simhash.similarity(sets[x], sets[y]) for y in others]


def test_only_sketches_that_meet_move(spark):
    ids = [0, 1, 2, 7, 8, 9, 32767, 32768, 32769, *range(65530, 65550), *((3 << 33) + i for i in range(40)), (1 << 50) + 5]
    wanted = [i for i in ids if i % 3 == 1 or i in (0, 32768, (3 << 33))]
    sketches = spark.createDataFrame([(i, bytes([i % 256])) for i in ids], "row long, shingles binary")
    places = spark.createDataFrame([(i, k) for i in wanted for k in range(3)], "row long, number int")
    got = simhash._meeting(sketches, places)
    assert sorted(r.row for r in got.collect()) == sorted(wanted) and got.columns == sketches.columns
    assert sorted(r.row for r in simhash._meeting(sketches, places, most=1).collect()) == sorted(ids)
    assert simhash._meeting(sketches, places.limit(0)).collect() == []
