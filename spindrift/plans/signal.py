"""Signals and events over ``events``: channels are users, samples are values in the order of (ts, event_id), and
hours are blocks. Geometry is a grid of ten channels a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.rounding import half_even
from spindrift.operators import detect as E
from spindrift.operators import geometry as G
from spindrift.operators import order as O
from spindrift.plans.registry import query, table


def samples(spark, sf_dir) -> DataFrame:
    """channel, t (microseconds), id, x, hour, kind."""
    ev = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(F.col("user_id").alias("channel"), t.alias("t"), F.col("event_id").alias("id"), F.col("value").alias("x"), F.floor(t / 3600000000).alias("hour"), F.col("event_type").alias("kind"))


S = """WITH s AS (SELECT user_id AS channel, epoch_us(ts) AS t, event_id AS id, value AS x, epoch_us(ts) // 3600000000 AS hour, event_type AS kind FROM events),
n AS (SELECT *, coalesce(x * x - lag(x) OVER w * lead(x) OVER w, 0) AS neo FROM s WINDOW w AS (PARTITION BY channel ORDER BY t, id))
"""


@query(S + "SELECT id, round(neo, 4) AS neo FROM n")
def g5_neo(spark, sf_dir):
    """Teager energy of each channel, zero at its ends."""
    return E.neo(samples(spark, sf_dir)).select("id", F.round("neo", 4).alias("neo"))


@query(S + ", m AS (SELECT channel, median(x) AS med FROM s GROUP BY channel) SELECT n.channel, round(8 * median(abs(neo)) / 0.6745, 4) AS neo_threshold, round(greatest(4 * 1.4826 * median(abs(x - med)), 5), 4) AS mad_threshold, round(median(abs(x - med)) / 0.6745, 4) AS noise FROM n JOIN m ON m.channel = n.channel GROUP BY n.channel")
def g6_g8_thresholds(spark, sf_dir):
    """Robust thresholds and noise of each channel."""
    return E.thresholds(E.neo(samples(spark, sf_dir)), 8.0, 4.0, 5.0).select("channel", *[F.round(c, 4).alias(c) for c in ("neo_threshold", "mad_threshold", "noise")])


GRID = S + """, g AS (SELECT hour AS t, channel % 8 AS r, channel // 8 % 6 AS c, CAST(max(round_even(x, 0)) AS BIGINT) AS v FROM s WHERE x >= 40 GROUP BY 1, 2, 3)
"""


@query(GRID + ", k AS (SELECT *, count(*) OVER (PARTITION BY t, r) AS a, count(*) OVER (PARTITION BY t, r % 4, c) AS b, count(*) OVER (PARTITION BY t, r, v) AS al, count(*) OVER (PARTITION BY t, r % 4, c, v) AS bl FROM g) SELECT t, r, c, v, a = 1 OR b = 1 AS by_frame, al = 1 OR bl = 1 AS by_level FROM k")
def g9_g10_wired_or(spark, sf_dir):
    """What survives shared wires, judged by frame and by ramp level."""
    s = samples(spark, sf_dir).where("x >= 40")
    grid = s.groupBy(F.col("hour").alias("t"), (F.col("channel") % 8).alias("r"), (F.floor(F.col("channel") / 8) % 6).alias("c")).agg(F.max(half_even(F.col("x"))).alias("v"))
    return E.wired_or(grid, 4)


@query(S + ", b AS (SELECT min(t) AS a, max(t) AS z FROM s) SELECT id, CAST(round_even(CASE WHEN abs(x) < 10 THEN 0 ELSE x END / 0.25, 0) AS BIGINT) AS code FROM s, b WHERE t >= a + 3600000000 AND t < z - 1800000000")
def g4_g11_guard_and_lsb(spark, sf_dir):
    """Events away from the ends, codes of a quarter each, small ones zero."""
    s = samples(spark, sf_dir)
    ends = s.agg(F.min("t").alias("a"), F.max("t").alias("z"))
    kept = s.crossJoin(F.broadcast(ends)).where((F.col("t") >= F.col("a") + 3600000000) & (F.col("t") < F.col("z") - 1800000000))
    return kept.select("id", half_even(F.when(F.abs("x") < 10, 0.0).otherwise(F.col("x")) / 0.25).alias("code"))


PEAK = S + ", p AS (SELECT hour, channel, CAST(max(round_even(abs(x) * 100, 0)) AS BIGINT) AS a FROM s GROUP BY hour, channel)\n"


@query(PEAK + "SELECT hour, channel, a FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.hour = p.hour AND o.channel IN (p.channel - 1, p.channel + 1) AND o.a > p.a)")
def e3_central_channels(spark, sf_dir):
    """An hour's peak of a channel falls if a neighbour's is larger (anti join)."""
    p = samples(spark, sf_dir).groupBy("hour", "channel").agg(F.max(half_even(F.abs("x") * 100)).alias("a"))
    near = p.select("hour", F.explode(F.array(F.col("channel") - 1, F.col("channel") + 1)).alias("channel"), F.col("a").alias("b"))
    loud = near.groupBy("hour", "channel").agg(F.max("b").alias("b"))
    return p.join(loud, ["hour", "channel"], "left").where(F.coalesce(F.col("b") <= F.col("a"), F.lit(True))).select("hour", "channel", "a")


@query(S + """, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS i, count(*) OVER (PARTITION BY channel) AS m FROM s),
w AS (SELECT e.id, e.channel, o.i - e.i AS k, o.x FROM o e JOIN o ON o.channel = e.channel AND o.i BETWEEN e.i - 2 AND e.i + 1 WHERE e.kind = 'purchase' AND e.i > 2 AND e.i < e.m)
SELECT id, string_agg(CAST(CAST(round_even(x * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS snippet, CAST(arg_min(CAST(round_even(x * 100, 0) AS BIGINT), -round_even(abs(x) * 100, 0) * 100 + k) AS BIGINT) AS peak FROM w GROUP BY id""")
def e5_e7_snippets(spark, sf_dir):
    """Four samples around an event, incomplete ones dropped; the signed value at the first largest."""
    order = Window.partitionBy("channel").orderBy("t", "id")
    code = half_even(F.col("x") * 100)
    s = samples(spark, sf_dir).withColumn("snip", F.array(*[F.lag(code, 2).over(order), F.lag(code, 1).over(order), code, F.lead(code, 1).over(order)]))
    cut = s.where((F.col("kind") == "purchase") & F.forall("snip", lambda v: v.isNotNull()))
    top = F.array_max(F.transform("snip", lambda v: F.abs(v)))
    return cut.select("id", F.array_join(F.col("snip").cast("array<string>"), ",").alias("snippet"), F.element_at(F.filter("snip", lambda v: F.abs(v) == top), 1).alias("peak"))


@query(S + """, e AS (SELECT *, x >= 80 AND coalesce(lag(x) OVER (PARTITION BY channel ORDER BY t, id) < 80, TRUE) AS rise FROM s)
SELECT hour, CAST(arg_min(channel, t * 1000 + channel) FILTER (WHERE x >= 80) AS BIGINT) AS first_hot, CAST(arg_min(channel, t * 1000 + channel) FILTER (WHERE rise) AS BIGINT) AS first_rise, CAST(coalesce(arg_min(channel, t * 1000 + channel) FILTER (WHERE x >= 80), arg_min(channel, -round_even(abs(x) * 100, 0) * 1000 + channel)) AS BIGINT) AS anchor FROM e GROUP BY hour""")
def e10_e11_first_channels(spark, sf_dir):
    """The first channel over a threshold, the first that rises over it, and the anchor otherwise."""
    before = F.lag("x").over(Window.partitionBy("channel").orderBy("t", "id"))
    s = samples(spark, sf_dir).withColumn("rise", (F.col("x") >= 80) & F.coalesce(before < 80, F.lit(True)))
    at = F.struct("t", "channel")
    hot = F.min(F.when(F.col("x") >= 80, at))["channel"]
    loud = F.min(F.struct((-half_even(F.abs("x") * 100)).alias("a"), "channel"))["channel"]
    return s.groupBy("hour").agg(hot.alias("first_hot"), F.min(F.when(F.col("rise"), at))["channel"].alias("first_rise"), F.coalesce(hot, loud).alias("anchor"))


@query(S + """, m AS (SELECT p.id, min(d.t * 100000 + d.id % 100000) AS k, min(d.t) AS dt FROM s p JOIN s d ON d.channel = p.channel AND d.kind = 'error' AND d.t BETWEEN p.t - 7200000000 AND p.t + 3600000000 WHERE p.kind = 'purchase' GROUP BY p.id)
SELECT p.id, CAST(coalesce(dt, p.t) - p.t AS BIGINT) AS lead, dt IS NOT NULL AS matched FROM s p LEFT JOIN m ON m.id = p.id WHERE p.kind = 'purchase'""")
def e13_interval_match(spark, sf_dir):
    """The earliest detection in an interval around each peak, else the peak itself."""
    s = samples(spark, sf_dir)
    return E.interval_match(s.where("kind = 'purchase'"), s.where("kind = 'error'"), 7200000000, 3600000000, ["channel"]).select("id", (F.coalesce("found", "t") - F.col("t")).alias("lead"), F.col("found").isNotNull().alias("matched"))


@query(PEAK + """, k AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY a DESC, channel) AS r, max(a) OVER (PARTITION BY hour) AS top FROM p)
SELECT hour, string_agg(CAST(channel AS VARCHAR), ',' ORDER BY channel) AS mask FROM k WHERE a >= 9500 OR (top < 9500 AND r <= 2) GROUP BY hour""")
def e14_trigger_masks(spark, sf_dir):
    """Channels over a threshold; where there are none, the two loudest."""
    p = samples(spark, sf_dir).groupBy("hour", "channel").agg(F.max(half_even(F.abs("x") * 100)).alias("a"))
    r = O.ranked(p, ["hour"], [F.desc("a"), "channel"], "r").withColumn("top", F.max("a").over(Window.partitionBy("hour")))
    kept = r.where((F.col("a") >= 9500) | ((F.col("top") < 9500) & (F.col("r") <= 2)))
    return kept.groupBy("hour").agg(F.array_join(F.array_sort(F.collect_set("channel")).cast("array<string>"), ",").alias("mask"))


GEOM = "WITH g AS (SELECT ch AS channel, ch % 10 * 20 AS x, ch // 10 * 20 + ch % 2 * 7 AS y FROM range(60) r(ch))\n"


@query(GEOM + ", d AS (SELECT a.channel, b.channel AS nbr, row_number() OVER (PARTITION BY a.channel ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.channel) AS r FROM g a JOIN g b ON a.channel <> b.channel) SELECT channel, r - 1 AS slot, nbr FROM d WHERE r <= 4")
def f1_f2_neighbours(spark, sf_dir):
    """nearest channels of a probe, ties to the smaller."""
    return G.neighbours(G.grid(spark, 60, 10), 4)


@query("""WITH e AS (SELECT r.r, c.c FROM range(6) r(r), range(5) c(c)), o(par, k, dr, dc) AS (VALUES (0, 0, 0, 1), (0, 1, -1, 0), (0, 2, -1, -1), (0, 3, 0, -1), (0, 4, 1, -1), (0, 5, 1, 0), (1, 0, 0, 1), (1, 1, -1, 1), (1, 2, -1, 0), (1, 3, 0, -1), (1, 4, 1, 0), (1, 5, 1, 1))
SELECT r, c, CAST(k AS BIGINT) AS slot, CASE WHEN v THEN r + dr ELSE r END AS nr, CASE WHEN v THEN c + dc ELSE c END AS nc, v AS valid FROM (SELECT *, r + dr BETWEEN 0 AND 5 AND c + dc BETWEEN 0 AND 4 AS v FROM e JOIN o ON par = r % 2)""")
def f3_hex_neighbours(spark, sf_dir):
    """six neighbours on staggered rows; those outside are the electrode itself."""
    return G.hex_neighbours(spark, 6, 5)


W = """WITH ev AS (SELECT vec_id, label AS unit, CAST(embedding AS DOUBLE[]) AS w FROM embeddings), l AS (SELECT vec_id, unit, i AS k, abs(w[i + 1]) AS p, w[i + 1] AS x FROM ev, range(7) r(i)),
"""


def footprints(spark, sf_dir):
    """vec_id, unit, w, p (7 footprint sizes)."""
    ev = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("unit"), F.col("embedding").cast("array<double>").alias("w"))
    return ev.withColumn("p", F.transform(F.slice("w", 1, 7), lambda x: F.abs(x)))


@query(W + """a AS (SELECT vec_id, sum(p) AS m, sum(p * k * 20) / greatest(sum(p), 1e-10) AS com, max(p) AS top, sum(p * k * 20 * k * 20) / greatest(sum(p), 1e-10) AS sq FROM l GROUP BY vec_id),
z AS (SELECT l.vec_id, string_agg(CAST(CAST(round_even(p / greatest(top, 1e-10) * 15, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS codes, string_agg(CAST(CAST(floor(least(greatest(CASE WHEN p0 > 1e-10 THEN p / p0 ELSE 0 END, 0), 2) * 1000 + 0.001) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS ratios FROM l JOIN a ON a.vec_id = l.vec_id JOIN (SELECT vec_id, p AS p0 FROM l WHERE k = 0) z0 ON z0.vec_id = l.vec_id GROUP BY l.vec_id)
SELECT a.vec_id, round(com / 120, 6) AS com, round(least(greatest(sqrt(greatest(sq - com * com, 0)) / 120, 0), 1), 6) AS spread, round(top / greatest(m, 1e-10), 6) AS sharpness, codes, ratios FROM a JOIN z ON z.vec_id = a.vec_id""")
def f7_f12_footprints(spark, sf_dir):
    """Centre of mass, spread, sharpness, maximum-scaled codes, ratios to the first slot."""
    f = G.soft_location(footprints(spark, sf_dir), "p", [20.0 * k for k in range(7)], 120.0)
    codes = F.transform("p", lambda x: half_even(x / F.greatest(F.array_max("p"), F.lit(1e-10)) * 15))
    ratios = F.transform("p", lambda x: F.floor(F.least(F.greatest(F.when(F.col("p")[0] > 1e-10, x / F.col("p")[0]).otherwise(0.0), F.lit(0.0)), F.lit(2.0)) * 1000 + 0.001))
    joined = lambda a: F.array_join(a.cast("array<string>"), ",")
    return f.select("vec_id", *[F.round(c, 6).alias(c) for c in ("com", "spread", "sharpness")], joined(codes).alias("codes"), joined(ratios).alias("ratios"))


@query(W + """s AS (SELECT unit, k, avg(p) AS m, stddev_pop(p) AS sd, var_pop(p) AS v, count(*) AS n FROM l GROUP BY unit, k), g AS (SELECT k, avg(p) AS gm, var_pop(p) AS gv FROM l GROUP BY k),
f AS (SELECT s.k, sum(n * (m - gm) * (m - gm)) / greatest(sum(n * v), 1e-12) AS fi FROM s JOIN g ON g.k = s.k GROUP BY s.k)
SELECT g.k AS slot, round(fi / sum(fi) OVER (), 6) AS fisher, round(gv / sum(gv) OVER (), 6) AS variance, round(exp(gm / 0.05) / sum(exp(gm / 0.05)) OVER (), 6) AS softmax FROM g JOIN f ON f.k = g.k""")
def f17_f19_weights(spark, sf_dir):
    """attention weights by Fisher ratio and variance, and a softmax of means."""
    return G.slot_weights(footprints(spark, sf_dir), "p", 0.05).select("slot", *[F.round(c, 6).alias(c) for c in ("fisher", "variance", "softmax")])


@query(W + """s AS (SELECT unit, k, avg(p) AS m FROM l GROUP BY unit, k), p AS (SELECT unit, k, m / sum(m) OVER (PARTITION BY unit) AS wt FROM s WHERE unit < 5)
SELECT vec_id, round(sum(l.p * coalesce(wt, 1.0 / 7)), 6) AS weighted FROM l LEFT JOIN p ON p.unit = l.unit AND p.k = l.k GROUP BY vec_id""")
def f18_profile_weights(spark, sf_dir):
    """weights of a known cluster's profile, equal weights otherwise."""
    f = footprints(spark, sf_dir)
    return G.apply_profiles(f, G.profiles(f.where("unit < 5"), "p", 7), "p", 7).select("vec_id", F.round("weighted", 6).alias("weighted"))


@query("""WITH ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings), l AS (SELECT vec_id, i, w[i + 1] AS x FROM ev, range(64) r(i)), c AS (SELECT vec_id, i, CAST(round_even(x * 1000, 0) AS BIGINT) AS v, lag(CAST(round_even(x * 1000, 0) AS BIGINT)) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM l)
SELECT vec_id, min(v) AS lo, max(v) AS hi, max(v) - min(v) AS p2p, max(abs(v)) AS top, CAST(arg_min(i, v * 100 + i) AS BIGINT) AS argmin, CAST(arg_min(i, -v * 100 + i) AS BIGINT) AS argmax, CAST(sum(v) FILTER (WHERE i < 16) AS BIGINT) AS early, CAST(sum(v) FILTER (WHERE i >= 16 AND i < 40) AS BIGINT) AS middle, CAST(sum(v) FILTER (WHERE i >= 40) AS BIGINT) AS late, CAST(sum(least(v, 0)) AS BIGINT) AS below, CAST(sum(greatest(v, 0)) AS BIGINT) AS above, CAST(sum(CASE WHEN (v >= 0) <> (b >= 0) THEN 1 ELSE 0 END) AS BIGINT) AS turns FROM c GROUP BY vec_id""")
def f21_f22_morphology(spark, sf_dir):
    """twelve shape features of a waveform, in thousandths."""
    ev = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: half_even(x.cast("double") * 1000)).alias("v"))
    return G.morphology(ev, "v")


@query("""WITH ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings), l AS (SELECT vec_id, i AS k, w[i + 1] AS x FROM ev, range(3) r(i)), f AS (SELECT k, avg(x) AS m, greatest(stddev_pop(x), 1e-8) AS sd FROM l WHERE vec_id % 2 = 0 GROUP BY k)
SELECT vec_id, l.k AS lane, round((x - m) / sd, 6) AS z FROM l JOIN f ON f.k = l.k""")
def f23_zscore(spark, sf_dir):
    """means and population deviations of fit rows, applied to all."""
    ev = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 1, 3)).alias("lane", "x"))
    fit = ev.where("vec_id % 2 = 0").groupBy("lane").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-8)).alias("sd"))
    return ev.join(F.broadcast(fit), "lane").select("vec_id", F.col("lane").cast("long").alias("lane"), F.round((F.col("x") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query(S + """, c AS (SELECT hour, sum(count(*)) OVER (ORDER BY hour) AS b FROM s GROUP BY hour), nn AS (SELECT count(*) AS n FROM s), h AS (SELECT hour AS h2 FROM c, nn ORDER BY abs(b - n * 0.5), b LIMIT 1),
k AS (SELECT c1.hour AS h1, c2.hour AS h3 FROM c c1 JOIN c c2 ON c1.b < c2.b, nn WHERE c2.b < n ORDER BY (c1.b - n * 0.5) * (c1.b - n * 0.5) + (c2.b - n * 0.75) * (c2.b - n * 0.75), c1.b, c2.b LIMIT 1)
SELECT id, CAST(hour > h2 AS INTEGER) AS two, CAST(hour > h1 AS INTEGER) + CAST(hour > h3 AS INTEGER) AS three FROM s, h, k""")
def w2_w5_splits(spark, sf_dir):
    """Chronological halves and 50/25/25 parts that never divide equal times."""
    s = samples(spark, sf_dir).select("id", "hour")
    two = O.split_two(s, "hour").withColumnRenamed("part", "two")
    return O.split_three(two, "hour").select("id", "two", F.col("part").alias("three"))


@query(S + ", o AS (SELECT id, row_number() OVER (ORDER BY hour, id) AS r, count(*) OVER () AS n FROM s) SELECT id, CAST(r > floor(n * 0.3) AS INTEGER) AS part FROM o")
def w6_naive_split(spark, sf_dir):
    """The first 30 % of rows, equal times divided."""
    return O.naive_split(samples(spark, sf_dir).select("id", "hour"), ["hour", "id"], 0.3).select("id", "part")


@query(S + """, b AS (SELECT channel, hour // 24 AS day, count(*) AS n FROM s GROUP BY 1, 2)
SELECT channel, day, n, CAST(coalesce(sum(n) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(n) OVER (PARTITION BY channel ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling, n - coalesce(lag(n) OVER (PARTITION BY channel ORDER BY day), 0) AS delta FROM b""")
def t3_t6_blocks(spark, sf_dir):
    """Day blocks; what a block may know from earlier ones, a rolling history, changes."""
    return E.blocks(samples(spark, sf_dir).withColumn("day", F.floor(F.col("hour") / 24)), "channel", "day", 2)


@query(S + ", c AS (SELECT *, lag(kind) OVER (PARTITION BY channel ORDER BY t, id) AS b FROM s) SELECT id, channel, kind FROM c WHERE b IS DISTINCT FROM kind")
def w16_changes(spark, sf_dir):
    """Events whose kind differs from the one before in their channel."""
    return O.changes(samples(spark, sf_dir), ["channel"], ["t", "id"], "kind").select("id", "channel", "kind")


@query(S + ", r AS (SELECT channel, count(*) AS n, CAST(sum(round_even(x * 100, 0)) AS BIGINT) AS v FROM s GROUP BY channel), k AS (SELECT *, row_number() OVER (ORDER BY n, channel) AS a, row_number() OVER (ORDER BY v, channel) AS b FROM r) SELECT round(corr(a, b), 6) AS spearman FROM k")
def a26_spearman(spark, sf_dir):
    """Rank correlation without averaging ties, over channels."""
    r = samples(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(half_even(F.col("x") * 100)).alias("v"))
    k = r.withColumns({"a": F.row_number().over(Window.orderBy("n", "channel")), "b": F.row_number().over(Window.orderBy("v", "channel"))})  # a row a channel
    return k.agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(S + "SELECT kind, count(*) AS n, CAST(sum(CASE WHEN x >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN x >= 50 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS share, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM s GROUP BY ROLLUP (kind)")
def a27_a28_rollup(spark, sf_dir):
    """Statistics by kind and over all, shares weighted by events."""
    hit = F.sum((F.col("x") >= 50).cast("long"))
    return samples(spark, sf_dir).rollup("kind").agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), F.round(hit / F.count(F.lit(1)), 6).alias("share"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"))
