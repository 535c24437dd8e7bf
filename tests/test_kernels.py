import itertools
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift import sources
from spindrift.operators import kernels as K
from spindrift.operators import order as O


def test_band_pass_passes_the_band_and_nothing_else():
    fs, sos = 24000, K.butterworth_sos(300, 6000, 24000)
    z = np.exp(2j * np.pi * np.array([1.0, 300, 1400, 6000, 11900]) / fs)
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos], axis=0)
    assert np.allclose(np.abs(h[[1, 3]]), np.sqrt(0.5), atol=1e-6)  # half the power at the edges
    assert abs(h[2]) > 0.99 and abs(h[0]) < 1e-6 and abs(h[4]) < 1e-3


@given(st.lists(st.integers(1, 40), min_size=1, max_size=6))
@settings(max_examples=20, deadline=None)
def test_causal_filter_does_not_show_chunks(sizes):
    x = np.random.default_rng(sum(sizes)).normal(size=sum(sizes))
    sos = K.butterworth_sos(300, 6000, 24000)
    whole, _ = K.sos_filter(sos, x)
    state, parts = None, []
    for a, b in itertools.pairwise([0, *np.cumsum(sizes)]):
        y, state = K.sos_filter(sos, x[a:b], state)
        parts.append(y)
    assert np.array_equal(np.concatenate(parts), whole)


def test_zero_phase_is_symmetric_and_steady():
    sos = K.butterworth_sos(300, 6000, 24000)
    x = np.zeros(4001)  # long enough for the response to die away
    x[2000] = 1
    y = K.zero_phase(sos, x)
    assert np.allclose(y, y[::-1], atol=1e-9)
    assert np.allclose(K.zero_phase(sos, np.full(300, 5.0)), 0, atol=1e-9)
    assert len(K.zero_phase(sos, np.array([1.0]))) == 1


def test_refractory_and_peaks():
    assert K.refractory(np.array([0, 3, 5, 9, 10, 15]), 5).tolist() == [True, False, True, False, True, True]
    assert K.peaks_with_refractory(np.array([0, 2, 5, 3, 0, 0, 4, 9, 0]), 1, 3).tolist() == [2, 7]
    assert K.saturating_counter(np.array([1, 1, 1, 0, 0, 0, 0, 1], bool), 2).tolist() == [1, 2, 2, 1, 0, 0, 0, 1]


def test_greedy_match():
    assert K.greedy_match(np.array([10, 12, 50]), np.array([11, 13, 49, 51]), 3).tolist() == [0, 1, 2]
    assert K.greedy_match(np.array([10, 12]), np.array([11]), 3).tolist() == [0, -1]
    assert K.greedy_match(np.array([], int), np.array([1]), 3).tolist() == []


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_assignment_is_the_best(n, m, seed):
    s = np.random.default_rng(seed).integers(0, 20, (n, m))
    pairs = K.assignment(s)
    small = s if n <= m else s.T
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert sum(s[r, c] for r, c in pairs) == best and len(pairs) == min(n, m)


def test_adaptation_and_tournament():
    wins, c, writes = K.ema_adapt(np.array([[8, 0], [8, 0]]), np.array([[0, 0], [10, 10]]), np.array([0, 0]), 1)
    assert wins.tolist() == [0, 0] and c.tolist() == [[6, 0], [10, 10]] and writes == 2
    assert K.tournament([1, 2, 3], {(1, 2): (5, 4), (1, 3): (0, 9), (2, 3): (7, 7)}) == 2
    assert K.tournament([], {}) is None


def test_som_finds_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (200, 2)) for c in ((0, 0), (3, 3), (0, 3))])
    a = K.Som(units=12, merge=0.8, seed=2).fit(x).assign(x)
    assert sorted(len(set(a[i : i + 200].tolist())) for i in (0, 200, 400)) == [1, 1, 1] and len(set(a.tolist())) == 3


def test_splits(spark):
    rows = [(i, t) for i, t in enumerate([5, 5, 5, 7, 7, 9000, 9000, 20001, 30000, 30000])]
    df = spark.createDataFrame(rows, "id long, t long")
    times = sorted(t for _, t in rows)
    assert [O.value_at_rank(df, "t", k) for k in range(10)] == times
    assert {r.id: r.part for r in O.split_two(df, "t").collect()} == {i: int(i > 4) for i in range(10)}
    three = {r.id: r.part for r in O.split_three(df, "t").collect()}
    assert [three[i] for i in range(10)] == [0] * 5 + [1] * 2 + [2] * 3
    wide = df.withColumn("t", df.t * 10**9)  # too wide for one count: radix narrowing
    assert {r.id: r.part for r in O.split_two(wide, "t").collect()} == {i: int(i > 4) for i in range(10)}
    assert {r.id: r.part for r in O.split_three(wide, "t").collect()} == three
    assert [r.part for r in O.naive_split(df, ["t", "id"], 0.3).orderBy("id").collect()] == [0] * 3 + [1] * 7


def test_sources(spark, tmp_path):
    x = np.arange(60.0).reshape(3, 20)
    np.savez(tmp_path / "a.npz", raw_data=x.T, geom=np.zeros((3, 2)), fs=10, spike_times_0based=np.array([4, 4, 19]), spike_unit_ids=np.array(["#7", "#8", "#7"]))
    got = sources.chunks(spark, str(tmp_path), block=8).orderBy("channel", "block").collect()
    assert [len(r.x) for r in got] == [8, 8, 4] * 3 and got[3].x == x[1, :8].tolist()
    assert sources.chunks(spark, str(tmp_path), duration_s=0.5).count() == 3
    assert [(r.t, r.unit) for r in sources.ground_truth(spark, str(tmp_path)).orderBy("event_row_id").collect()] == [(4, 7), (4, 8), (19, 7)]
    m = np.arange(6, dtype="<i2").reshape(2, 3)
    (tmp_path / "m.mda").write_bytes(struct.pack("<iiiii", -4, 2, 2, 2, 3) + m.tobytes(order="F"))
    assert [r.x for r in sources.mda(spark, str(tmp_path)).orderBy("row").collect()] == m.tolist()
    a, b = spark.createDataFrame([(1, [2])], "k int, v array<int>"), spark.createDataFrame([("x",)], "w string")
    sources.write_report(sources.union_rows(a, b), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="JSON"):
        sources.canonical_json(float("nan"))
    assert sources.digest({"b": 1, "a": 2}) == sources.digest({"a": 2, "b": 1})


def test_synthetic_recording(spark):
    channels, samples, events = sources.synthetic_recording(spark, neurons=3, channels=8, seconds=0.2, fs=5000)
    assert channels.count() == 8 and samples.count() == 8 * 1000 and events.count() > 0
    gaps = [b.t - a.t for a, b in itertools.pairwise(events.where("neuron = 0").orderBy("t").collect())]
    assert all(g >= 10 for g in gaps)


def test_streams_equal_batch(spark, tmp_path):
    from spindrift import streaming
    from spindrift.operators import sequential as Q

    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), i, float(rng.normal())) for i, (t, c) in enumerate(zip(np.sort(rng.integers(0, 1000, 90)), rng.integers(0, 2, 90), strict=True))]
    schema = "channel int, t long, id long, x double"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    for name, make, batch in (("filter", lambda s: streaming.causal_filter(s, 300, 6000, 24000), lambda b: Q.filtered(b, 300, 6000, 24000, causal=True).select("channel", "t", "id", "y")), ("gap", lambda s: streaming.suppressed(s, 25), lambda b: Q.suppress(b, 25))):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = make(src).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(map(tuple, spark.table(f"out_{name}").collect()))
        assert got == sorted(map(tuple, batch(spark.createDataFrame(rows, schema)).collect()))


def test_valley_detector():
    x = np.array([0, 0, -1, -5, -20, -6, -3, 0, 0, 0, -30, 0, 0, 0.0])
    assert K.valley_detections(x).tolist() == [4] and K.valley_detections(x, at_valley=False).tolist() == [6]
    assert K.valley_detections(x, low=25).tolist() == [] and K.valley_detections(x[:3]).tolist() == []


def test_grid_map_finds_the_places_of_events():
    rng = np.random.default_rng(4)
    n = 1200
    kind = rng.integers(0, 3, n)
    rows, cols = np.array([0, 2, 3])[kind], np.array([0, 2, 0])[kind]
    t = np.sort(rng.integers(0, 6000, n))
    dx, dy = rng.normal(np.array([10, -12, 0])[kind], 1), rng.normal(np.array([5, 8, -10])[kind], 1)
    m = K.GridMap(4, 3).fit(t, dx, dy, rows, cols, 1000)
    ids = m.batch(dx, dy, rows, cols, learn=False)
    assert m.settled and (ids > 0).all()
    assert all(len(set(ids[kind == k].tolist())) == 1 for k in range(3)) and len(set(ids.tolist())) == 3
    assert K.GridMap(2, 2).fit(t[:0], dx[:0], dy[:0], rows[:0], cols[:0], 10).settled is False
