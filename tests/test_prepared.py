"""Windows, local sizes and their codes against plain NumPy, at the ends of a recording and on ties."""

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import prepare as P

CHANNELS, LENGTH = 5, 200


def signal_of(spark, x):
    """Chunks of a (channels, samples) array, the last one filled up."""
    full = np.zeros((x.shape[0], -(-x.shape[1] // P.CHUNK) * P.CHUNK), dtype=np.int64)
    full[:, : x.shape[1]] = x
    rows = [(c, k, full[c, k * P.CHUNK : (k + 1) * P.CHUNK].tolist()) for c in range(x.shape[0]) for k in range(full.shape[1] // P.CHUNK)]
    return spark.createDataFrame(rows, "channel long, chunk long, xs array<long>")


def recording():
    x = np.random.default_rng(1).integers(-50, 50, (CHANNELS, LENGTH))
    x[2, 100], x[3, 101] = -900, 900  # a tie of sizes: the first channel is central
    return x


def test_windows_are_whole_and_only_those(spark):
    x = recording()
    times = [0, 14, 15, 63, 64, 100, 100, 151, 152, 185, 199]
    ev = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, t long")
    kept = P.inside(ev, F.lit(LENGTH), 15, 49)
    assert [r.t for r in kept.orderBy("id").collect()] == [15, 63, 64, 100, 100, 151]
    strict = P.inside(ev, F.lit(LENGTH), 15, 15, strict=True)
    assert max(r.t for r in strict.collect()) == 152  # 185 + 15 is the end itself
    got = {(r.t, r.channel): r.xs for r in P.windows(kept, signal_of(spark, x), 15, 49).collect()}
    assert len(got) == 5 * CHANNELS
    for (t, c), xs in got.items():
        assert xs == x[c, t - 15 : t + 49].tolist()
    one = P.windows(kept.withColumn("channel", F.lit(4).cast("long")), signal_of(spark, x), 15, 49)
    assert {(r.t, r.channel) for r in one.collect()} == {(t, 4) for t in (15, 63, 64, 100, 151)}


def test_local_sizes(spark):
    x = recording()
    times = spark.createDataFrame([(20,), (100,), (140,)], "t long")
    slots = spark.createDataFrame([(c, s, (c + s) % CHANNELS) for c in range(CHANNELS) for s in range(3)], "channel long, slot long, nbr long")
    got = {r.t: r for r in P.local_sizes(P.windows(times, signal_of(spark, x), 15, 49), slots, 30).collect()}
    for t, r in got.items():
        part = x[:, t - 15 : t + 15]
        central = int(np.abs(part).max(axis=1).argmax())
        assert r.central == central and r.nbr == [(central + s) % CHANNELS for s in range(3)]
        assert r.p2p == [int(np.ptp(part[c])) for c in r.nbr]
        assert r.xs == x[central, t - 15 : t + 49].tolist()
    assert got[100].central == 2


def test_size_codes_and_centre(spark):
    rows = spark.createDataFrame([(1, [10, 20, 5], [0, 1, 2]), (2, [0, 8, 4], [2, 1, 0]), (3, [0, 0, 0], [0, 1, 2])], "id int, p array<long>, nbr array<long>")
    most = F.lit(40)
    got = {r.id: r for r in rows.select("id", P.size_codes("p", 15, "per_spike_max").alias("a"), P.size_codes("p", 15, "global_max", most=most).alias("b"), P.size_codes("p", 15, "lsb", lsb=1.0).alias("l"), P.size_codes("p", 15, "central_ratio").alias("o"), P.size_codes("p", 15, "none").alias("n"), P.centre("p", "nbr", {0: 0, 1: 20, 2: 40}).alias("com")).collect()}
    assert (got[1].a, got[1].b, got[1].l, got[1].o) == ([8, 15, 4], [4, 8, 2], [10, 15, 5], [8, 15, 4])
    assert (got[2].a, got[2].o) == ([0, 15, 8], [0, 0, 0])  # a central slot of zero gives zeros
    assert got[3].a == [0, 0, 0] and got[3].com == 0.0
    assert got[1].n == [10.0, 20.0, 5.0]
    assert abs(got[1].com - (20 * 20 + 5 * 40) / 35 / 40) < 1e-12


def test_empty_events(spark):
    none = spark.createDataFrame([], "t long")
    assert P.windows(none, signal_of(spark, recording()), 15, 49).count() == 0
