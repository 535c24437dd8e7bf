"""Preparation of events, end to end. The recording is the hours of ``events``: channels are user_id mod 60, a sample is
the sum of an hour's values in hundredths (zero where there are none), and events to prepare are purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.rounding import half_even
from spindrift.operators import bank as B
from spindrift.operators import geometry as G
from spindrift.operators import prepare as P
from spindrift.operators import sequential as Q
from spindrift.plans.registry import query
from spindrift.plans.retrieval import BASE, fitted, text
from spindrift.plans.signal import GEOM, S, samples

CHANNELS, PER_ROW, SLOTS = 60, 10, 7
#: Samples before and after an event: for peaks, and after it for waveforms.
HALF, POST = 15, 49


def recording(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(chunks of the signal, events with id, t, unit, stated and length)."""
    s = samples(spark, sf_dir)
    ends = F.broadcast(s.agg(F.min("hour").alias("h0"), (F.max("hour") - F.min("hour") + 1).alias("length")))
    s = s.crossJoin(ends).withColumn("at", F.col("hour") - F.col("h0"))
    sums = s.groupBy((F.col("channel") % CHANNELS).alias("channel"), "at").agg(F.sum(half_even(F.col("x") * 100)).alias("v"))
    held = sums.groupBy("channel", F.floor(F.col("at") / P.CHUNK).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at") % P.CHUNK, "v"))).alias("m"))
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / P.CHUNK))).alias("chunk")).join(spark.range(CHANNELS).select(F.col("id").alias("channel")))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(P.CHUNK - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")))
    signal = grid.join(held, ["channel", "chunk"], "left").select("channel", "chunk", dense.alias("xs"))
    ev = s.where("kind = 'purchase'").select("id", F.col("at").alias("t"), (F.col("channel") % 5).alias("unit"), (F.col("channel") % 64).alias("stated"), "length")
    return signal, ev


def sizes(spark, sf_dir, after: int) -> DataFrame:
    """Events whose windows are whole, with central, xs, nbr and p2p."""
    signal, ev = recording(spark, sf_dir)
    kept = P.inside(P.inside(ev, F.col("length"), HALF, HALF, strict=True), F.col("length"), HALF, after)
    slots = G.neighbours(G.grid(spark, CHANNELS, PER_ROW), SLOTS, with_self=True)
    return kept.join(P.local_sizes(P.windows(kept.select("t"), signal, HALF, after), slots, 2 * HALF), "t")


REC = S + """, r AS (SELECT min(hour) AS h0, max(hour) - min(hour) + 1 AS len FROM s),
d AS (SELECT channel % 60 AS ch, hour - h0 AS t, CAST(sum(round_even(x * 100, 0)) AS BIGINT) AS v FROM s, r GROUP BY 1, 2),
sig AS (SELECT c.ch, h.t, coalesce(d.v, 0) AS v FROM range(60) c(ch) CROSS JOIN (SELECT unnest(range(len)) AS t FROM r) h LEFT JOIN d ON d.ch = c.ch AND d.t = h.t),
ev AS (SELECT id, hour - h0 AS t, channel % 5 AS unit, channel % 64 AS stated, len FROM s, r WHERE kind = 'purchase'),
tt AS (SELECT DISTINCT t, len FROM ev WHERE t >= 15 AND t < len - 15),
w AS (SELECT tt.t, ch, max(v) - min(v) AS p2p, max(abs(v)) AS a FROM tt JOIN sig ON sig.t >= tt.t - 15 AND sig.t < tt.t + 15 GROUP BY tt.t, ch),
c AS (SELECT t, arg_min(ch, -a * 100 + ch) AS central FROM w GROUP BY t),
geo AS (SELECT ch AS channel, ch % 10 * 20 AS x, ch // 10 * 20 + ch % 2 * 7 AS y FROM range(60) q(ch)),
nb AS (SELECT a.channel, b.channel AS nbr, b.x, b.y, row_number() OVER (PARTITION BY a.channel ORDER BY a.channel <> b.channel, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.channel) - 1 AS slot FROM geo a, geo b),
f AS (SELECT c.t, c.central, nb.slot, nb.nbr, nb.x, nb.y, w.p2p FROM c JOIN nb ON nb.channel = c.central AND nb.slot < 7 JOIN w ON w.t = c.t AND w.ch = nb.nbr)
"""


@query(REC + "SELECT id, f.t, central, slot, nbr, p2p FROM ev JOIN f ON f.t = ev.t")
def f6_local_sizes(spark, sf_dir):
    """peak-to-peak sizes of an event's central channel and its neighbours; events near the ends drop out."""
    f = sizes(spark, sf_dir, HALF).select("id", "t", "central", F.posexplode("p2p").alias("slot", "p2p"), "nbr")
    return f.select("id", "t", "central", F.col("slot").cast("long").alias("slot"), F.get("nbr", F.col("slot")).alias("nbr"), "p2p")


@query(REC + """, m AS (SELECT t, max(p2p) AS top, max(p2p) FILTER (WHERE slot = 0) AS own FROM f GROUP BY t), z AS (SELECT max(p2p) AS most FROM f),
k AS (SELECT f.t, slot, round_even(p2p / greatest(top, 1e-8) * 15, 0) AS a, round_even(p2p / greatest(most, 1e-8) * 15, 0) AS b, least(round_even(p2p / CAST(5000 AS DOUBLE), 0), 15) AS l, round_even(CASE WHEN own > 1e-8 THEN least(p2p / own, 2) ELSE 0 END / 2 * 15, 0) AS o FROM f JOIN m ON m.t = f.t, z),
j AS (SELECT t, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY slot) AS by_event, string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR), ',' ORDER BY slot) AS by_all, string_agg(CAST(CAST(l AS BIGINT) AS VARCHAR), ',' ORDER BY slot) AS by_step, string_agg(CAST(CAST(o AS BIGINT) AS VARCHAR), ',' ORDER BY slot) AS by_central FROM k GROUP BY t)
SELECT id, by_event, by_all, by_step, by_central FROM ev JOIN j ON j.t = ev.t""")
def f8_size_codes(spark, sf_dir):
    """F8: four-bit codes of local sizes in all four modes."""
    f = sizes(spark, sf_dir, HALF).select("id", "p2p")
    most = f.agg(F.max(F.array_max("p2p")).alias("most"))
    code = lambda mode, **more: text(P.size_codes("p2p", 15, mode, **more))
    return f.crossJoin(F.broadcast(most)).select("id", code("per_spike_max").alias("by_event"), code("global_max", most=F.col("most")).alias("by_all"), code("lsb", lsb=5000.0).alias("by_step"), code("central_ratio").alias("by_central"))


@query(REC + """, g AS (SELECT t, central, sum(p2p) AS mass, sum(p2p * x) AS mx, sum(p2p * y) AS my, max(p2p) AS top FROM f GROUP BY t, central),
h AS (SELECT f.t, string_agg(CAST(CAST(round_even(p2p / greatest(top, 1e-8) * 1000000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY slot) AS footprint FROM f JOIN g ON g.t = f.t GROUP BY f.t),
v AS (SELECT c.t, max(abs(v)) AS size FROM c JOIN sig ON sig.ch = c.central AND sig.t >= c.t - 15 AND sig.t < c.t + 49 GROUP BY c.t),
wv AS (SELECT c.t, string_agg(CAST(CAST(round_even(v / greatest(size, 1e-8) * 1000000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY sig.t) AS waveform FROM c JOIN sig ON sig.ch = c.central AND sig.t >= c.t - 15 AND sig.t < c.t + 49 JOIN v ON v.t = c.t GROUP BY c.t)
SELECT id, ev.t, unit, central, round(central / CAST(59 AS DOUBLE), 6) AS main, round(mx / greatest(mass, 1e-8) / 180, 6) AS com_x, round(my / greatest(mass, 1e-8) / 107, 6) AS com_y, footprint, waveform FROM ev JOIN g ON g.t = ev.t JOIN h ON h.t = ev.t JOIN wv ON wv.t = ev.t WHERE ev.t + 49 <= len""")
def f24_prepared_events(spark, sf_dir):
    """E8, E9 (strict), F9, F24: labels carried by row, central channel and its share of the probe, centre of mass,
    normalised footprint and normalised waveform of 64 samples; numbers of arrays in millionths."""
    place = {c: (c % PER_ROW * 20, c // PER_ROW * 20 + c % 2 * 7) for c in range(CHANNELS)}
    f = sizes(spark, sf_dir, POST)
    parts = lambda c: F.greatest(F.array_max(F.transform(c, F.abs)).cast("double"), F.lit(1e-8))
    scaled = lambda c: text(F.transform(c, lambda x: half_even(x / parts(c) * 1000000)))
    com = [F.round(P.centre("p2p", "nbr", {c: xy[axis] for c, xy in place.items()}), 6) for axis in (0, 1)]
    return f.select("id", "t", "unit", "central", F.round(F.col("central") / float(CHANNELS - 1), 6).alias("main"), com[0].alias("com_x"), com[1].alias("com_y"), scaled("p2p").alias("footprint"), scaled("xs").alias("waveform"))


@query(REC + """, p AS (SELECT id, t, least(stated, 59) AS ch, t >= 15 AND t + 49 <= len AS whole FROM ev), x AS (SELECT t, ch, string_agg(CAST(v AS VARCHAR), ',' ORDER BY st) AS wave FROM (SELECT p.t, p.ch, sig.t AS st, sig.v FROM (SELECT DISTINCT t, ch FROM p WHERE whole) p JOIN sig ON sig.ch = p.ch AND sig.t >= p.t - 15 AND sig.t < p.t + 49) GROUP BY t, ch)
SELECT id, p.ch AS channel, whole, coalesce(wave, repeat('0,', 63) || '0') AS waveform FROM p LEFT JOIN x ON x.t = p.t AND x.ch = p.ch""")
def e9_filled_waveforms(spark, sf_dir):
    """E9 (zero-filled, clipped): waveforms of the stated channels, clipped to the probe; zeros where one isn't whole."""
    signal, ev = recording(spark, sf_dir)
    ev = ev.select("id", "t", "length", F.least(F.greatest("stated", F.lit(0)), F.lit(CHANNELS - 1)).cast("long").alias("channel"))
    cut = P.windows(P.inside(ev, F.col("length"), HALF, POST), signal, HALF, POST)
    zeros = F.array_repeat(F.lit(0).cast("long"), HALF + POST)
    return ev.join(cut, ["t", "channel"], "left").select("id", "channel", F.col("xs").isNotNull().alias("whole"), text(F.coalesce("xs", zeros)).alias("waveform"))


@query(GEOM + """, a AS (SELECT *, CASE WHEN (SELECT var_pop(y) FROM g) >= (SELECT var_pop(x) FROM g) THEN y ELSE x END AS k FROM g), o AS (SELECT x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM a WINDOW w AS (ORDER BY k, channel))
SELECT round(median(sqrt(dx * dx + dy * dy)), 6) AS spacing FROM o WHERE dx IS NOT NULL""")
def a19_channel_spacing(spark, sf_dir):
    """Median distance of adjacent channels along a probe's longer axis. A probe is small: one task orders it."""
    g = G.grid(spark, CHANNELS, PER_ROW)
    axis = F.broadcast(g.agg((F.var_pop("y") >= F.var_pop("x")).alias("upright")))
    w = Window.orderBy(F.when(F.col("upright"), F.col("y")).otherwise(F.col("x")), "channel")
    steps = g.crossJoin(axis).select((F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    return steps.where("dx IS NOT NULL").agg(F.round(F.percentile(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.5)), 6).alias("spacing"))


@query(BASE + """, hm AS (SELECT unit, arg_min(d, -m * 100 + d) AS home FROM cen GROUP BY unit), an AS (SELECT vec_id, arg_min(d, -c * 100 + d) AS anchor FROM testc GROUP BY vec_id),
g AS (SELECT vec_id, unit, abs(home - anchor) AS gap, greatest(1, min(abs(home - anchor)) OVER (PARTITION BY vec_id)) AS radius FROM an, hm)
SELECT vec_id, CAST(radius AS BIGINT) AS radius, string_agg(CAST(unit AS VARCHAR), ',' ORDER BY unit) AS units FROM g WHERE gap <= radius GROUP BY vec_id, radius""")
def j13_index_band(spark, sf_dir):
    """Units whose home lane lies within a band of the event's, widened until it holds one: the radius is the
    larger of the stated one and the nearest home's distance."""
    _, second, bank = fitted(spark, sf_dir)
    first_top = lambda a: (F.array_position(a, F.array_max(a)) - 1)
    anchored = second.withColumn("anchor", first_top(F.col("q")))
    rows = B.met(anchored, bank.withColumn("home", first_top(F.col("centroid"))), {"gap": lambda u: F.abs(u["home"] - F.col("anchor"))})
    radius = F.greatest(F.lit(1).cast("long"), F.array_min(F.transform("rows", lambda r: r["gap"])))
    return rows.withColumn("radius", radius).select("vec_id", "radius", text(B.units_where("rows", lambda r: r["gap"] <= F.col("radius"))).alias("units"))


@query()
def r11_detection(spark, sf_dir):
    """Precision, recall and F1 of detections after the one-to-one match."""
    # Each side is read by itself: plans that share columns can't be matched and counted in one.
    gt, found, all_found = (samples(spark, sf_dir).where(F.col("kind") == k) for k in ("purchase", "error", "error"))
    matched = Q.match(gt, found, 3600000000).agg(F.count("found_id").alias("tp"), F.count(F.lit(1)).alias("gt"))
    one = matched.crossJoin(F.broadcast(all_found.agg(F.count(F.lit(1)).alias("pred"))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("pred")), share(F.col("tp"), F.col("gt"))
    return one.select("tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(share(2 * p * r, p + r), 6).alias("f1"))
