"""Policies, sequences, gates and relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import bank as B
from spindrift.operators import metrics as M
from spindrift.operators import order as O
from spindrift.operators import sequential as Q
from spindrift.plans.registry import query, table
from spindrift.plans.retrieval import BASE, BOX, D, boxed, distance, events, fitted, text
from spindrift.plans.signal import samples


@query(BOX + """, k AS (SELECT vec_id, truth, arg_min(u, CASE WHEN need = 0 THEN 0 ELSE 1 END * 100000000 + dist * 1000 + u) AS p, max(CASE WHEN need = 0 THEN 1 ELSE 0 END) AS inside FROM bp GROUP BY vec_id, truth)
SELECT vec_id, CAST(p AS INTEGER) AS pred, inside = 1 AS boxed, p = truth AS correct FROM k""")
def j18_box_preferred(spark, sf_dir):
    """The nearest row among boxes that hold the codes, else of all."""
    _, second, bank = boxed(spark, sf_dir)
    rows = B.met(second, bank, {"box": lambda u: B.inside_box(u, F.col("q"), D), "d": lambda u: distance(F.col("q"), u["centroid"])})
    pred = F.array_min(F.transform("rows", lambda r: F.struct((~r["box"]).alias("out"), r["d"].alias("d"), r["row_id"].alias("k"), r["unit"].alias("unit"))))
    return rows.select("vec_id", pred["unit"].alias("pred"), (~pred["out"]).alias("boxed"), (pred["unit"] == F.col("unit")).alias("correct"))


@query(BASE + """, wc AS (SELECT unit, d, avg(x) AS m FROM lane, cut WHERE t <= ct GROUP BY unit, d),
g AS (SELECT t.vec_id, t.unit AS truth, cen.unit AS u, sum(CASE WHEN t.d < 2 THEN (c - m) * (c - m) END) AS com, sum(CASE WHEN t.d >= 2 THEN abs(c - m) END) AS p2p FROM testc t JOIN cen ON cen.d = t.d GROUP BY t.vec_id, t.unit, cen.unit),
wd AS (SELECT g.vec_id, g.u, round(sqrt(sum((x - m) * (x - m))), 6) AS dw FROM g JOIN lane ON lane.vec_id = g.vec_id JOIN wc ON wc.unit = g.u AND wc.d = lane.d GROUP BY g.vec_id, g.u),
b AS (SELECT g.vec_id, truth, arg_min(g.u, dw * 1000000000 + g.u) FILTER (WHERE com < 49 AND p2p < 30) AS gated, arg_min(g.u, round(sqrt(com) / 7 + p2p / 30.0, 6) * 1000000000 + g.u) AS back FROM g JOIN wd ON wd.vec_id = g.vec_id AND wd.u = g.u GROUP BY g.vec_id, truth)
SELECT vec_id, truth, CAST(coalesce(gated, back) AS INTEGER) AS pred, gated IS NULL AS fallback FROM b""")
def j20_two_stage(spark, sf_dir):
    """A strict two-threshold gate, then the nearest mean waveform (L2); else the least normalised score."""
    first, second, bank = fitted(spark, sf_dir)
    waves = first.groupBy("unit").agg(F.array(*[F.avg(F.col("w")[i]) for i in range(64)]).alias("wave"))
    q = F.col("q")
    com = lambda u: V.total([(q[i] - u["centroid"][i]) * (q[i] - u["centroid"][i]) for i in (0, 1)])
    p2p = lambda u: V.total([F.abs(q[i] - u["centroid"][i]) for i in range(2, D)])
    rows = B.met(second, bank.join(waves, "unit"), {"in": lambda u: (com(u) < 49) & (p2p(u) < 30), "dw": lambda u: F.round(V.l2(F.col("w"), u["wave"]), 6), "s": lambda u: F.round(F.sqrt(com(u)) / 7 + p2p(u) / 30, 6)})
    inside = F.filter("rows", lambda r: r["in"])
    gated = F.when(F.size(inside) > 0, B.nearest(inside, lambda r: r["dw"])["unit"])
    return rows.select("vec_id", F.col("unit").alias("truth"), F.coalesce(gated, B.nearest("rows", lambda r: r["s"])["unit"]).alias("pred"), gated.isNull().alias("fallback"))


@query(BASE + """, nt AS (SELECT vec_id, list(DISTINCT d) FILTER (WHERE c >= 17) AS a FROM testc GROUP BY vec_id), nu AS (SELECT unit, list(DISTINCT d) FILTER (WHERE m >= 16) AS b FROM cen GROUP BY unit), ty AS (SELECT vec_id, sum(d * c) // sum(c) // 2 AS q FROM testc GROUP BY vec_id), tu AS (SELECT unit, sum(d * m) // sum(m) // 2 AS h FROM cen GROUP BY unit),
j AS (SELECT nt.vec_id, nu.unit, CASE WHEN len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) > 0 THEN len(list_intersect(coalesce(a, []), coalesce(b, []))) * 1.0 / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) ELSE 0 END AS s, abs(q - h) AS tile FROM nt, nu, ty, tu WHERE ty.vec_id = nt.vec_id AND tu.unit = nu.unit)
SELECT vec_id, count(*) FILTER (WHERE s >= 0.5) AS similar, count(*) FILTER (WHERE tile <= 0) AS same_tile FROM j GROUP BY vec_id""")
def j14_j15_tile_and_jaccard(spark, sf_dir):
    """Rows whose tile is the event's, and rows whose high lanes are alike."""
    _, second, bank = fitted(spark, sf_dir)
    high = lambda a, least: F.filter(F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: F.when(F.get(a, i) >= least, i)), lambda i: i.isNotNull())
    tile = lambda a: F.floor(F.floor(V.total([a[i] * i for i in range(D)]) / V.total([a[i] for i in range(D)])) / 2)
    rows = B.met(second.withColumns({"a": high(F.col("q"), 17), "tq": tile(F.col("q"))}), bank.withColumns({"b": high(F.col("centroid"), 16), "h": tile(F.col("centroid"))}), {"s": lambda u: V.jaccard(F.col("a"), u["b"]), "tile": lambda u: F.abs(F.col("tq") - u["h"])})
    n = lambda f: F.size(F.filter("rows", f)).cast("long")
    return rows.select("vec_id", n(lambda r: r["s"] >= 0.5).alias("similar"), n(lambda r: r["tile"] <= 0).alias("same_tile"))


@query(BASE + """, ap AS (SELECT f.vec_id, f.unit, cen.unit AS u, sum(abs(c - m)) AS dist FROM fitc f JOIN cen ON cen.d = f.d GROUP BY f.vec_id, f.unit, cen.unit), an AS (SELECT vec_id, unit, arg_min(u, dist * 1000 + u) AS anchor FROM ap GROUP BY vec_id, unit),
cc AS (SELECT anchor, unit, count(*) AS n FROM an GROUP BY anchor, unit), g AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, unit) AS pos, sum(n) OVER (PARTITION BY anchor ORDER BY n DESC, unit ROWS UNBOUNDED PRECEDING) - n AS cum, sum(n) OVER (PARTITION BY anchor) AS tot FROM cc),
k AS (SELECT vec_id, u, row_number() OVER (PARTITION BY vec_id ORDER BY dist, u) AS r FROM pair), h AS (SELECT vec_id, g.unit, min(r * 1000 + pos) AS o FROM k JOIN g ON g.anchor = k.u WHERE r <= 2 AND cum < ceil(tot * 0.8) GROUP BY vec_id, g.unit)
SELECT vec_id, string_agg(CAST(unit AS VARCHAR), ',' ORDER BY o) AS candidates FROM h GROUP BY vec_id""")
def j24_graph_union(spark, sf_dir):
    """The union of the two nearest anchors' lists, anchor by anchor, each unit once."""
    first, second, bank = fitted(spark, sf_dir)
    near = B.met(first, bank, {"d": lambda u: distance(F.col("q"), u["centroid"])}).select("unit", B.nearest("rows", lambda r: r["d"])["unit"].alias("anchor"))
    kept = O.minimal_coverage(near.groupBy("anchor", "unit").agg(F.count(F.lit(1)).alias("n")), ["anchor"], "n", "unit", 0.8)
    lists = kept.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "unit"))), lambda x: x["unit"]).alias("list"))
    graph = bank.join(lists, F.col("unit") == F.col("anchor"), "left").drop("anchor")
    rows = B.met(second, graph, {"d": lambda u: distance(F.col("q"), u["centroid"]), "list": lambda u: F.coalesce(u["list"], F.array().cast("array<int>"))})
    two = F.slice(F.array_sort(F.transform("rows", lambda r: F.struct(r["d"].alias("d"), r["row_id"].alias("k"), r["list"].alias("list")))), 1, 2)
    found = F.array_distinct(F.flatten(F.transform(two, lambda x: x["list"])))
    return rows.select("vec_id", text(found).alias("candidates")).where("candidates <> ''")


@query("SELECT CAST(lanes AS INTEGER) AS lanes, CAST(lanes * 5 + CASE WHEN lanes * 31 > 0 THEN floor(log2(lanes * 31)) + 1 ELSE 1 END AS BIGINT) AS l1_bits, CAST(2 * lanes * 5 AS BIGINT) AS box_bits, CAST(lanes * 5 + floor(log2(lanes * 31)) + 1 + lanes AS BIGINT) AS masked_bits, CAST(lanes * 5 + floor(log2(lanes * 31)) + 1 + lanes * 10 AS BIGINT) AS dual_bits, CAST(lanes * 7 + floor(log2(lanes * 124)) + 1 AS BIGINT) AS weighted_bits FROM range(1, 17) r(lanes)")
def r3_row_bits(spark, sf_dir):
    """Storage of rows by lanes: L1, box, masked, both ranges at once, and weighted (two bits of shift a lane and
    a radius of the fourfold scale)."""
    lanes = spark.range(1, 17).select(F.col("id").cast("int").alias("lanes"))
    w = M.width(F.col("lanes") * 31)
    return lanes.select("lanes", (F.col("lanes") * 5 + w).alias("l1_bits"), (F.col("lanes") * 10).cast("long").alias("box_bits"), (F.col("lanes") * 6 + w).alias("masked_bits"), (F.col("lanes") * 15 + w).alias("dual_bits"), (F.col("lanes") * 7 + M.width(F.col("lanes") * 124)).alias("weighted_bits"))


@query("""WITH o AS (SELECT o_custkey AS unit, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS hits FROM orders GROUP BY 1)
SELECT unit, n, hits, round(greatest((hits * 1.0 / n + 3.8414588206941254 / (2 * n)) / (1 + 3.8414588206941254 / n) - 1.959963984540054 * sqrt(hits * 1.0 / n * (1 - hits * 1.0 / n) / n + 3.8414588206941254 / (4 * n * n)) / (1 + 3.8414588206941254 / n), 0), 6) AS low, hits * 100 >= 50 * n AS gate, n >= 4 * hits AS reduction FROM o""")
def r16_r17_gates(spark, sf_dir):
    """Gates by cross-multiplied whole numbers, and two-sided Wilson bounds."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") > 150000, 1)).alias("hits"))
    low, _ = M.wilson_interval(F.col("hits"), F.col("n"))
    return o.select("unit", "n", "hits", F.round(low, 6).alias("low"), (F.col("hits") * 100 >= F.col("n") * 50).alias("gate"), (F.col("n") >= F.col("hits") * 4).alias("reduction"))


@query("""WITH s AS (SELECT l_suppkey AS k, CAST(sum(round_even(l_quantity, 0)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT max(q) AS q, min(n) AS n FROM (SELECT q, n FROM s ORDER BY q DESC, n, k LIMIT 1))
SELECT k, s.q, s.n, s.q <= b.q AND s.n >= b.n AND (s.q < b.q OR s.n > b.n) AS dominated FROM s, b""")
def w14_w15_winner_and_dominance(spark, sf_dir):
    """The winner in a stated order with ties, and what it dominates."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(F.rint("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"))
    best = s.orderBy(F.desc("q"), "n", "k").limit(1).select(F.col("q").alias("bq"), F.col("n").alias("bn"))  # one row
    return s.crossJoin(F.broadcast(best)).select("k", "q", "n", ((F.col("q") <= F.col("bq")) & (F.col("n") >= F.col("bn")) & ((F.col("q") < F.col("bq")) | (F.col("n") > F.col("bn")))).alias("dominated"))


@query("""SELECT c_custkey AS key, 'both' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def w12_s9_sets(spark, sf_dir):
    """Intersection and difference of key sets (semi and anti joins)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return c.join(o, "key", "left_semi").withColumn("side", F.lit("both")).unionByName(c.join(o, "key", "left_anti").withColumn("side", F.lit("none")))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://([^./]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^./]+)', 2) AS name, sha256(url) AS digest FROM pages""")
def s13_s19_names_and_digests(spark, sf_dir):
    """Parts of a name by pattern, content digests."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?)://([^./]+)", 1).alias("scheme"), F.regexp_extract("url", "^(https?)://([^./]+)", 2).alias("name"), F.sha2("url", 256).alias("digest"))


@query("""WITH RECURSIVE s AS (SELECT user_id AS channel, epoch_us(ts) AS t, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT channel, t, id, i, t AS last, TRUE AS keep FROM s WHERE i = 1 UNION ALL SELECT s.channel, s.t, s.id, s.i, CASE WHEN s.t - f.last >= 36000000000 THEN s.t ELSE f.last END, s.t - f.last >= 36000000000 FROM f JOIN s ON s.channel = f.channel AND s.i = f.i + 1)
SELECT channel, t, id FROM f WHERE keep""")
def t9_refractory(spark, sf_dir):
    """Events of a channel at least ten hours after the last kept one."""
    return Q.suppress(samples(spark, sf_dir), 36000000000)


@query()
def g1_band_pass(spark, sf_dir):
    """Zero-phase Butterworth band-pass of each channel."""
    return Q.filtered(samples(spark, sf_dir), 300, 6000, 24000).select("channel", "id", F.round("y", 6).alias("y"))


@query()
def g2_causal_band_pass(spark, sf_dir):
    """Causal band-pass of each channel from a zero state."""
    return Q.filtered(samples(spark, sf_dir), 300, 6000, 24000, causal=True).select("channel", "id", F.round("y", 6).alias("y"))


@query()
def e2_counter(spark, sf_dir):
    """Saturating counter of each channel."""
    return Q.counted(samples(spark, sf_dir), 50.0).select("id", "counter")


@query()
def e16_greedy_match(spark, sf_dir):
    """One-to-one match of two kinds of events within an hour."""
    s = samples(spark, sf_dir)
    return Q.match(s.where("kind = 'purchase'"), s.where("kind = 'error'"), 3600000000)


@query()
def t7_online_adaptation(spark, sf_dir):
    """Predict, then move the winner's centroid; one sequence a recording."""
    first, second, bank = fitted(spark, sf_dir)
    return Q.adapted(second.select((F.col("vec_id") % 4).alias("recording"), "t", F.col("vec_id").alias("id"), "q"), bank.withColumn("theta", F.lit(0)), 3)


@query()
def m2_som(spark, sf_dir):
    """Clusters of a self-organising map of each recording."""
    ev = events(spark, sf_dir).select((F.col("vec_id") % 4).alias("recording"), F.col("vec_id").alias("id"), F.slice("w", 1, 9).alias("v"))
    return Q.discovered(ev, "v", units=9, seed=3)


@query()
def j31_best_accuracy(spark, sf_dir):
    """Accuracy under the best one-to-one relabelling of predictions."""
    from spindrift.plans.retrieval import j31_confusion

    return spark.createDataFrame([(round(Q.best_accuracy(j31_confusion(spark, sf_dir)), 6),)], "accuracy double")
