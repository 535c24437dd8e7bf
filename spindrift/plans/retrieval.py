"""Fitting and retrieval over ``embeddings``: units are labels, times are vec_id div 3 (so that times tie),
waveforms are the 64 components, and codes are nine of them in five bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import vectors as V
from spindrift.functions.rounding import divide_half_even
from spindrift.operators import bank as B
from spindrift.operators import order as O
from spindrift.plans.registry import query, table

D, WAVE, TOP = 9, 64, 31


def distance(a: Column, b: Column) -> Column:
    return V.l1(a, b, D)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, unit, t, w (64 doubles), q (9 codes)."""
    ev = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("unit"), F.floor(F.col("vec_id") / 3).alias("t"), F.col("embedding").cast("array<double>").alias("w"))
    return ev.withColumn("q", F.array(*[V.quantize_unsigned(F.col("w")[i] + 0.5, 5) for i in range(D)]))


def fitted(spark: SparkSession, sf_dir: str, percent: float = 95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first half, second half, bank with centroid and radius)."""
    ev = events(spark, sf_dir)
    cut = O.split_time(ev, "t")
    first, second = ev.where(F.col("t") <= cut), ev.where(F.col("t") > cut)
    bank = B.settled(B.numbered(B.radii(first, B.settled(B.centroids(first, D)), distance, percent)))
    return first, second, bank


def text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


BASE = """
WITH ev AS (SELECT vec_id, label AS unit, vec_id // 3 AS t, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
lane AS (SELECT vec_id, unit, t, i AS d, w[i + 1] AS x FROM ev, range(64) r(i)),
code AS (SELECT vec_id, unit, t, d, CAST(round_even(least(greatest(x + CAST(0.5 AS DOUBLE), 0), 1) * 31, 0) AS BIGINT) AS c FROM lane WHERE d < 9),
cum AS (SELECT t, sum(count(*)) OVER (ORDER BY t) AS b FROM ev GROUP BY t),
cut AS (SELECT t AS ct FROM cum, (SELECT count(*) AS n FROM ev) ORDER BY abs(b - n * 0.5), b LIMIT 1),
fitc AS (SELECT code.* FROM code, cut WHERE t <= ct),
testc AS (SELECT code.* FROM code, cut WHERE t > ct),
cen AS (SELECT unit, d, CAST(round_even(avg(c), 0) AS BIGINT) AS m FROM fitc GROUP BY unit, d),
own AS (SELECT vec_id, f.unit, sum(abs(c - m)) AS dist FROM fitc f JOIN cen ON cen.unit = f.unit AND cen.d = f.d GROUP BY vec_id, f.unit),
rad AS (SELECT unit, CAST(ceil(round(quantile_cont(dist, 0.95), 9)) AS BIGINT) AS r, count(*) AS n FROM own GROUP BY unit),
pair AS (SELECT vec_id, t.unit AS truth, cen.unit AS u, CAST(sum(abs(c - m)) AS BIGINT) AS dist FROM testc t JOIN cen ON cen.d = t.d GROUP BY vec_id, t.unit, cen.unit)
"""


@query(BASE + """
SELECT p.vec_id, p.truth AS label, count(*) FILTER (WHERE dist <= r) AS n_candidates, CAST(max(CASE WHEN dist <= r AND u = truth THEN 1 ELSE 0 END) AS INTEGER) AS hit,
  coalesce(string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) FILTER (WHERE dist <= r), '') AS candidates, CAST(arg_min(u, dist * 1000 + u) AS INTEGER) AS nn_unit
FROM pair p JOIN rad ON rad.unit = u GROUP BY p.vec_id, p.truth""")
def range_search_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, tie-safe halves, centroids, radii, L1 range search, nearest row."""
    _, second, bank = fitted(spark, sf_dir)
    rows = B.met(second, bank, {"d": lambda u: distance(F.col("q"), u["centroid"]), "r": lambda u: u["radius"]})
    found = rows.withColumn("c", B.units_where("rows", lambda r: r["d"] <= r["r"]))
    return found.select("vec_id", F.col("unit").alias("label"), F.size("c").cast("long").alias("n_candidates"), F.array_contains("c", F.col("unit")).cast("int").alias("hit"), text(F.col("c")).alias("candidates"), B.nearest("rows", lambda r: r["d"])["unit"].alias("nn_unit"))


@query(BASE + """, s AS (SELECT d, min(c) AS a, max(c) AS b FROM code GROUP BY d)
SELECT vec_id, code.d, CAST(round_even(least(greatest((c - a) / CAST(CASE WHEN b > a THEN b - a ELSE 1 END AS DOUBLE), 0), 1) * 15, 0) AS BIGINT) AS code FROM code JOIN s ON s.d = code.d""")
def q1_quantize_fit(spark, sf_dir):
    """Per-lane minimum and maximum, then unsigned codes of four bits."""
    ev = events(spark, sf_dir)
    ends = ev.agg(*[F.min(F.col("q")[i]).alias(f"a{i}") for i in range(D)], *[F.max(F.col("q")[i]).alias(f"b{i}") for i in range(D)])
    codes = F.array(*[V.quantize_unsigned(F.col("q")[i], 4, F.col(f"a{i}"), F.col(f"b{i}")) for i in range(D)])
    return ev.crossJoin(F.broadcast(ends)).select("vec_id", F.posexplode(codes).alias("d", "code")).withColumn("d", F.col("d").cast("long"))


@query(BASE + """, s AS (SELECT quantile_cont(abs(x), 0.999) AS q FROM lane), p AS (SELECT CASE WHEN q > 0 THEN pow(2.0, ceil(log2(q))) ELSE 1 END AS scale FROM s),
a AS (SELECT vec_id, d, x, x / scale * 15 AS y FROM lane, p)
SELECT vec_id, d, CAST(round_even(least(greatest(x, -1), 1) * 15, 0) AS BIGINT) AS even, CAST(least(greatest(sign(y) * floor(abs(y) + 0.5), -15), 15) AS BIGINT) AS away FROM a""")
def q2_q4_signed_codes(spark, sf_dir):
    """Q2, Q3, Q4: signed codes, half to even and half away with a power-of-two scale."""
    ev = events(spark, sf_dir)
    lanes = ev.select("vec_id", F.posexplode("w").alias("d", "x"))
    scale = lanes.agg(V.power_of_two_scale(F.percentile(F.abs("x"), F.lit(0.999))).alias("s"))
    return lanes.crossJoin(F.broadcast(scale)).select("vec_id", F.col("d").cast("long").alias("d"), V.quantize_signed(F.col("x"), 5).alias("even"), V.quantize_signed_away(F.col("x"), F.col("s")).alias("away"))


FILTERS = "filt AS (SELECT k, s, CAST(p * s AS BIGINT) AS a, CAST(p * s + s AS BIGINT) AS b FROM (VALUES ('mean', 2), ('mean', 4), ('mean', 8), ('mean', 16), ('mean', 32), ('haar', 4), ('haar', 8), ('haar', 16), ('haar', 32), ('haar', 64)) v(k, s), range(32) r(p) WHERE p * s < 64)"


@query(BASE + f""", {FILTERS}, sc AS (SELECT vec_id, d, CAST(round_even(least(greatest(x, -1), 1) * 15, 0) AS BIGINT) AS c FROM lane),
z AS (SELECT vec_id, k, s, a, CAST(sum(CASE WHEN k = 'mean' OR d < a + s // 2 THEN c ELSE -c END) AS BIGINT) AS n FROM filt JOIN sc ON d >= a AND d < b GROUP BY vec_id, k, s, a)
SELECT vec_id, k AS kind, CAST(s AS BIGINT) AS support, a AS start, CAST(sign(n) * ((abs(n) * 2 + s) // (s * 2)) AS BIGINT) AS code FROM z""")
def q6_dyadic_codes(spark, sf_dir):
    """Q5, Q6: dyadic means and Haar differences of signed codes, exact division half away from zero. The filters
    are a static table; prefix sums make each filter two differences, without a join of samples."""
    from spindrift.functions.rounding import divide_half_away

    codes = events(spark, sf_dir).select("vec_id", F.array(*[V.quantize_signed(F.col("w")[i], 5) for i in range(WAVE)]).alias("c"))

    def run(a: int, b: int) -> Column:
        return V.array_sum(F.slice("c", a + 1, b - a), "long")

    made = []
    for kind, supports in (("mean", (2, 4, 8, 16, 32)), ("haar", (4, 8, 16, 32, 64))):
        for s in supports:
            for a in range(0, WAVE, s):
                n = run(a, a + s) if kind == "mean" else run(a, a + s // 2) - run(a + s // 2, a + s)
                made.append(F.struct(F.lit(kind).alias("kind"), F.lit(s).cast("long").alias("support"), F.lit(a).cast("long").alias("start"), divide_half_away(n, F.lit(s)).alias("code")))
    return codes.select("vec_id", F.inline(F.array(*made)))


@query(BASE + """, m AS (SELECT vec_id, avg(c) AS mean FROM code GROUP BY vec_id), z AS (SELECT code.vec_id, d, c - mean AS y FROM code JOIN m ON m.vec_id = code.vec_id),
k(j, th) AS (VALUES (0, 2.0), (1, 5.0), (2, 9.0))
SELECT vec_id, string_agg(CASE WHEN greatest(CASE sg WHEN 0 THEN y ELSE -y END, 0) >= th THEN '1' ELSE '0' END, '' ORDER BY sg, d, j) AS bits FROM z, k, (VALUES (0), (1)) s(sg) GROUP BY vec_id""")
def q7_q9_thermometer(spark, sf_dir):
    """Q7, Q9: removal of the mean, positive and negative parts, thermometer bits."""
    ev = events(spark, sf_dir)
    flat = V.remove_dc(F.col("q").cast("array<double>"))
    return ev.select("vec_id", F.array_join(V.bipolar_thermometer(flat, [2.0, 5.0, 9.0], [2.0, 5.0, 9.0]).cast("array<string>"), "").alias("bits"))


@query(BASE + """, a AS (SELECT c AS x FROM code), u AS (SELECT quantile_cont(x, 0.99) AS p FROM a)
SELECT CAST(j AS INTEGER) AS level, round(p * j / 4, 6) AS uniform, round(i[j], 6) AS interior FROM u, (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS i FROM a), (VALUES (1), (2), (3), (4)) t(j)""")
def q8_thermometer_thresholds(spark, sf_dir):
    """Q8: thresholds spread evenly to the 99th percentile, and interior quantiles."""
    x = events(spark, sf_dir).select(F.explode("q").alias("x"))
    at = x.agg(F.percentile("x", F.array(*[F.lit(v) for v in (0.99, 0.2, 0.4, 0.6, 0.8)])).alias("p"))
    rows = F.array(*[F.struct(F.lit(j).alias("level"), F.round(F.col("p")[0] * j / 4, 6).alias("uniform"), F.round(F.col("p")[j], 6).alias("interior")) for j in (1, 2, 3, 4)])
    return at.select(F.inline(rows))


@query(BASE + """, b AS (SELECT d, c FROM code WHERE vec_id = 0), j AS (SELECT vec_id, code.c AS x, b.c AS y FROM code JOIN b ON b.d = code.d)
SELECT vec_id, CAST(sum(abs(x - y)) AS BIGINT) AS l1, round(sqrt(sum((x - y) * (x - y))), 6) AS l2, CAST(sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS BIGINT) AS hamming,
  round(CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) ELSE 0 END, 6) AS cosine, CAST(-sum(x * y) AS BIGINT) AS neg_dot,
  round(CAST(len(list_intersect(list(x), list(y))) AS DOUBLE) / len(list_distinct(list_concat(list(x), list(y)))), 6) AS jaccard
FROM j GROUP BY vec_id""")
def q11_distances(spark, sf_dir):
    """Distances of every row to one stated row."""
    ev = events(spark, sf_dir)
    one = ev.where("vec_id = 0").select(F.col("q").alias("b"))  # one row
    a, b = F.col("q"), F.col("b")
    return ev.crossJoin(F.broadcast(one)).select("vec_id", distance(a, b).alias("l1"), F.round(V.l2(a, b), 6).alias("l2"), V.hamming(a, b).alias("hamming"), F.round(V.cosine(a, b), 6).alias("cosine"), V.neg_dot(a, b).cast("long").alias("neg_dot"), F.round(V.jaccard(a, b), 6).alias("jaccard"))


@query(BASE + ", near AS (SELECT own.*, n, row_number() OVER (PARTITION BY own.unit ORDER BY dist, vec_id) AS k FROM own JOIN rad ON rad.unit = own.unit)" + """,
e AS (SELECT f.unit, f.d, min(c) AS a, max(c) AS b FROM fitc f JOIN near ON near.vec_id = f.vec_id AND k <= ceil(n * 0.9) GROUP BY f.unit, f.d)
SELECT cen.unit, cen.d, m AS centroid, least(m, a) AS lo, greatest(m, b) AS hi, r AS radius, n FROM cen JOIN e ON e.unit = cen.unit AND e.d = cen.d JOIN rad ON rad.unit = cen.unit""")
def a2_a6_unit_bank(spark, sf_dir):
    """Integer centroids, radii and coverage boxes."""
    first, _, bank = fitted(spark, sf_dir)
    full = B.boxes(first, bank, distance, 0.9, D, "vec_id")
    return full.select("unit", F.posexplode(F.arrays_zip("centroid", "lo", "hi")).alias("d", "x"), "radius", "n").select("unit", F.col("d").cast("long").alias("d"), "x.centroid", "x.lo", "x.hi", "radius", "n")


BOX = BASE + """, near AS (SELECT own.*, n, row_number() OVER (PARTITION BY own.unit ORDER BY dist, vec_id) AS k FROM own JOIN rad ON rad.unit = own.unit),
e AS (SELECT f.unit, f.d, min(c) AS a, max(c) AS b FROM fitc f JOIN near ON near.vec_id = f.vec_id AND k <= ceil(n * 0.9) GROUP BY f.unit, f.d),
box AS (SELECT cen.unit, cen.d, m, least(m, a) AS lo, greatest(m, b) AS hi FROM cen JOIN e ON e.unit = cen.unit AND e.d = cen.d),
bp AS (SELECT vec_id, t.unit AS truth, box.unit AS u, max(greatest(0, lo - c, c - hi)) AS need, sum(abs(c - m)) AS dist FROM testc t JOIN box ON box.d = t.d GROUP BY vec_id, t.unit, box.unit)
"""


def boxed(spark, sf_dir):
    first, second, bank = fitted(spark, sf_dir)
    return first, second, B.settled(B.boxes(first, bank, distance, 0.9, D, "vec_id"))


@query(BOX + """, l AS (SELECT vec_id, CASE WHEN min(need) <= 2 THEN min(need) END AS level FROM bp GROUP BY vec_id)
SELECT bp.vec_id, CAST(level AS BIGINT) AS level, coalesce(string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) FILTER (WHERE need <= level), '') AS widened, coalesce(string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) FILTER (WHERE need = 0), '') AS boxed FROM bp JOIN l ON l.vec_id = bp.vec_id GROUP BY bp.vec_id, level""")
def j2_j3_box_widening(spark, sf_dir):
    """Box search, and the first level up to 2 at which any box holds the codes."""
    _, second, bank = boxed(spark, sf_dir)
    rows = B.met(second, bank, {"need": lambda u: B.box_excess(u, F.col("q"), D)})
    found, level = B.widened("rows", lambda r: r["need"], 2)
    return rows.select("vec_id", level.alias("level"), text(found).alias("widened"), text(B.units_where("rows", lambda r: r["need"] == 0)).alias("boxed"))


@query(BASE + """, x AS (SELECT vec_id, u, dist, r, greatest(0, dist - r) AS need FROM pair JOIN rad ON rad.unit = u), l AS (SELECT vec_id, min(need) AS m FROM x GROUP BY vec_id)
SELECT x.vec_id, CASE WHEN m <= 3 THEN string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) FILTER (WHERE need <= m) ELSE '' END AS candidates,
  CASE WHEN m > 3 THEN CAST(arg_min(u, need * 100000 // (r + 1) * 1000 + u) AS INTEGER) END AS fallback, CAST(CASE WHEN m <= 3 THEN m ELSE 3 END AS BIGINT) AS level, CAST(10 * (1 + CASE WHEN m <= 3 THEN m ELSE 3 END) AS BIGINT) AS row_comparisons
FROM x JOIN l ON l.vec_id = x.vec_id GROUP BY x.vec_id, m""")
def j3_j4_fallback(spark, sf_dir):
    """L1 widening up to 3, else the row of least relative excess; rows compared."""
    _, second, bank = fitted(spark, sf_dir)
    need = {"need": lambda u: F.greatest(F.lit(0).cast("long"), distance(F.col("q"), u["centroid"]) - u["radius"]), "r": lambda u: u["radius"]}
    rows = B.met(second, bank, need)
    found, level = B.widened("rows", lambda r: r["need"], 3)
    level_or = F.coalesce(level, F.lit(3).cast("long"))
    excess = lambda r: F.floor(r["need"] * 100000 / (r["r"] + 1))
    return rows.select("vec_id", text(found).alias("candidates"), F.when(level.isNull(), B.nearest("rows", excess)["unit"]).alias("fallback"), level_or.alias("level"), (F.size("rows") * (1 + level_or)).cast("long").alias("row_comparisons"))


HOME = """, home AS (SELECT vec_id, CAST(arg_min(d, CAST(-round(abs(x) * 1000000) AS BIGINT) * 100 + d) AS BIGINT) AS ch FROM lane WHERE d < 16 GROUP BY vec_id),
hc AS (SELECT f.unit, ch, count(*) AS n FROM (SELECT DISTINCT vec_id, unit FROM fitc) f JOIN home ON home.vec_id = f.vec_id GROUP BY f.unit, ch),
uh AS (SELECT unit, CAST(arg_min(ch, -n * 1000 + ch) AS BIGINT) AS h FROM hc GROUP BY unit),
sup AS (SELECT unit, ch FROM (SELECT *, sum(n) OVER (PARTITION BY unit ORDER BY n DESC, ch ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY unit) AS tot FROM hc) WHERE cum - n < ceil(tot * 0.6))
"""


def channel(w: Column) -> Column:
    """Of 16 channels (the first components), that of the largest absolute value, the smallest on a tie."""
    return F.array_min(F.array(*[F.struct((-F.round(F.abs(w[i]) * 1000000)).cast("long").alias("a"), F.lit(i).cast("long").alias("ch")) for i in range(16)]))["ch"]


def homes(first: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts by unit and channel, home channel of a unit, channels that cover 0.6 of a unit)."""
    counts = first.groupBy("unit", channel(F.col("w")).alias("ch")).agg(F.count(F.lit(1)).alias("n"))
    home = O.top(counts, ["unit"], [F.desc("n"), "ch"], 1).select("unit", F.col("ch").alias("home"))
    return counts, home, O.minimal_coverage(counts, ["unit"], "n", "ch", 0.6)


@query(BASE + HOME + "SELECT uh.unit, h AS home, string_agg(CAST(ch AS VARCHAR), ',' ORDER BY ch) AS support, count(*) AS n_support FROM uh JOIN sup ON sup.unit = uh.unit GROUP BY uh.unit, h")
def a16_a17_home_and_support(spark, sf_dir):
    """Anchor channels, a unit's home, and its minimal channel support."""
    first, _, _ = fitted(spark, sf_dir)
    _, home, support = homes(first)
    listed = support.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list("ch")).cast("array<string>"), ",").alias("support"), F.count(F.lit(1)).alias("n_support"))
    return home.join(listed, "unit")


@query(BASE + HOME + """SELECT p.vec_id, count(DISTINCT p.u) FILTER (WHERE abs(h - q.ch) <= 3) AS directory, count(DISTINCT p.u) FILTER (WHERE abs(s.ch - q.ch) <= 3) AS by_support,
  count(DISTINCT p.u) FILTER (WHERE abs(h - q.ch) <= 3 AND dist <= r) AS candidates, CAST(max(CASE WHEN abs(h - q.ch) <= 3 AND p.u = truth THEN 1 ELSE 0 END) AS INTEGER) AS reached
FROM pair p JOIN rad ON rad.unit = p.u JOIN uh ON uh.unit = p.u JOIN sup s ON s.unit = p.u JOIN home q ON q.vec_id = p.vec_id GROUP BY p.vec_id""")
def j5_j6_directories(spark, sf_dir):
    """Rows active by home or support within three channels, before the range search."""
    first, second, bank = fitted(spark, sf_dir)
    _, home, support = homes(first)
    listed = support.groupBy("unit").agg(F.array_sort(F.collect_list("ch")).alias("support"))
    rows = B.met(second.withColumn("ch", channel(F.col("w"))), bank.join(home, "unit").join(listed, "unit"), {"d": lambda u: distance(F.col("q"), u["centroid"]), "r": lambda u: u["radius"], "near": lambda u: F.abs(u["home"] - F.col("ch")) <= 3, "by": lambda u: F.exists(u["support"], lambda c: F.abs(c - F.col("ch")) <= 3)})
    n = lambda f: F.size(F.filter("rows", f)).cast("long")
    return rows.select("vec_id", n(lambda r: r["near"]).alias("directory"), n(lambda r: r["by"]).alias("by_support"), n(lambda r: r["near"] & (r["d"] <= r["r"])).alias("candidates"), F.exists("rows", lambda r: r["near"] & (r["unit"] == F.col("unit"))).cast("int").alias("reached"))


@query(BASE + """, pr AS (SELECT ceil(round(quantile_cont(dist, 0.95), 9)) AS r FROM own),
g AS (SELECT vec_id, cen.unit AS u, sum(CASE WHEN t.d < 2 THEN (c - m) * (c - m) END) AS com, sum(CASE WHEN t.d >= 2 THEN abs(c - m) END) AS p2p, sum(abs(c - m)) AS dist FROM testc t JOIN cen ON cen.d = t.d GROUP BY vec_id, cen.unit)
SELECT vec_id, count(*) FILTER (WHERE dist <= r) AS pooled, count(*) FILTER (WHERE dist < r) AS pooled_strict, count(*) FILTER (WHERE com < 36 AND p2p < 24) AS gate FROM g, pr GROUP BY vec_id""")
def j7_j8_pooled_and_gate(spark, sf_dir):
    """One radius of all units, inclusive and strict; the gate of two strict thresholds."""
    first, second, bank = fitted(spark, sf_dir)
    pooled = B.with_own(first, bank, "centroid").agg(B.ceil_percentile(distance(F.col("q"), F.col("centroid")), 95).alias("all_radius"))
    q = F.col("q")
    rows = B.met(second.crossJoin(F.broadcast(pooled)), bank, {"d": lambda u: distance(q, u["centroid"]), "com": lambda u: V.total([(q[i] - u["centroid"][i]) * (q[i] - u["centroid"][i]) for i in (0, 1)]), "p2p": lambda u: V.total([F.abs(q[i] - u["centroid"][i]) for i in range(2, D)])})
    n = lambda f: F.size(F.filter("rows", f)).cast("long")
    return rows.select("vec_id", n(lambda r: r["d"] <= F.col("all_radius")).alias("pooled"), n(lambda r: r["d"] < F.col("all_radius")).alias("pooled_strict"), n(lambda r: (r["com"] < 36) & (r["p2p"] < 24)).alias("gate"))


STABLE = """, dev AS (SELECT f.unit, f.d, quantile_cont(abs(c - m), 0.95) AS within FROM fitc f JOIN cen ON cen.unit = f.unit AND cen.d = f.d GROUP BY f.unit, f.d),
btw AS (SELECT a.unit, a.d, median(abs(a.m - b.m)) AS between_ FROM cen a JOIN cen b ON a.d = b.d AND a.unit <> b.unit GROUP BY a.unit, a.d),
st AS (SELECT dev.unit, dev.d, within, between_, row_number() OVER (PARTITION BY dev.unit ORDER BY within, dev.d) AS rs, row_number() OVER (PARTITION BY dev.unit ORDER BY between_ / (within + 1) DESC, dev.d) AS rb FROM dev JOIN btw ON btw.unit = dev.unit AND btw.d = dev.d)
"""


def lanes_by_stability(first: DataFrame, bank: DataFrame) -> DataFrame:
    """unit, d, within, between, rank by stability, rank by separation."""
    own = B.with_own(first, bank, "centroid")
    gaps = own.groupBy("unit").agg(F.array(*[F.percentile(F.abs(F.col("q")[i] - F.col("centroid")[i]), F.lit(0.95)) for i in range(D)]).alias("within"))
    other = bank.select(F.col("unit").alias("v"), F.col("centroid").alias("o"))
    pairs = bank.select("unit", "centroid").join(F.broadcast(other), F.col("unit") != F.col("v"))  # two rows of a small bank
    apart = pairs.groupBy("unit").agg(F.array(*[F.median(F.abs(F.col("centroid")[i] - F.col("o")[i])) for i in range(D)]).alias("between"))
    long = gaps.join(apart, "unit").select("unit", F.posexplode(F.arrays_zip("within", "between")).alias("d", "x")).select("unit", F.col("d").cast("long").alias("d"), "x.within", "x.between")
    return O.ranked(O.ranked(long, ["unit"], ["within", "d"], "stable"), ["unit"], [F.desc(F.col("between") / (F.col("within") + 1)), "d"], "separate")


@query(BASE + STABLE + "SELECT unit, d, round(within, 6) AS within, round(between_, 6) AS between_, CAST(rs <= 3 AS INTEGER) AS mask, CAST(CASE WHEN rs <= 3 THEN 4 ELSE 1 END AS INTEGER) AS top3, CAST(CASE WHEN rb <= 3 THEN 4 WHEN rb <= 6 THEN 2 ELSE 1 END AS INTEGER) AS tiered FROM st")
def a8_a10_masks_and_weights(spark, sf_dir):
    """Deviation within and separation between units, masks, power-of-two weights."""
    first, _, bank = fitted(spark, sf_dir)
    r = lanes_by_stability(first, bank)
    return r.select("unit", "d", F.round("within", 6).alias("within"), F.round("between", 6).alias("between_"), (F.col("stable") <= 3).cast("int").alias("mask"), B.rank_weights(F.col("stable"), "top3_x4").alias("top3"), B.rank_weights(F.col("separate"), "tiered_421").alias("tiered"))


MASKED = STABLE + """, ow AS (SELECT vec_id, f.unit, sum(CASE WHEN rs <= 3 THEN abs(c - m) ELSE 0 END) AS dm, sum(CASE WHEN rs <= 3 THEN 4 ELSE 1 END * abs(c - m)) AS dw FROM fitc f JOIN cen ON cen.unit = f.unit AND cen.d = f.d JOIN st ON st.unit = f.unit AND st.d = f.d GROUP BY vec_id, f.unit),
rr AS (SELECT unit, ceil(round(quantile_cont(dm, 0.95), 9)) AS rm, ceil(round(quantile_cont(dw, 0.95), 9)) AS rw, CAST(round_even(median(dw), 0) AS BIGINT) AS theta FROM ow GROUP BY unit),
tp AS (SELECT vec_id, t.unit AS truth, cen.unit AS u, sum(CASE WHEN rs <= 3 THEN abs(c - m) ELSE 0 END) AS dm, sum(CASE WHEN rs <= 3 THEN 4 ELSE 1 END * abs(c - m)) AS dw FROM testc t JOIN cen ON cen.d = t.d JOIN st ON st.unit = cen.unit AND st.d = cen.d GROUP BY vec_id, t.unit, cen.unit)
"""


@query(BASE + MASKED + """SELECT vec_id, count(*) FILTER (WHERE dm <= rm) AS masked, count(*) FILTER (WHERE dw <= rw) AS weighted, CAST(arg_min(u, (dw - theta) * 1000 + u) AS INTEGER) AS wta, CAST(max(CASE WHEN u = truth AND dw <= rw THEN 1 ELSE 0 END) AS INTEGER) AS hit FROM tp JOIN rr ON rr.unit = u GROUP BY vec_id""")
def j9_j10_j17_masked_weighted_wta(spark, sf_dir):
    """Masked and weighted range search, and the biased nearest row."""
    first, second, bank = fitted(spark, sf_dir)
    lanes = lanes_by_stability(first, bank).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("d", "stable"))).alias("s"))
    full = bank.join(lanes, "unit").withColumns({"mask": F.transform("s", lambda x: (x["stable"] <= 3).cast("long")), "weight": F.transform("s", lambda x: B.rank_weights(x["stable"], "top3_x4").cast("long"))}).drop("s")
    q, c = F.col("q"), F.col("centroid")
    own = B.with_own(first, full, "centroid", "mask", "weight").select("unit", V.masked_l1(q, c, F.col("mask"), D).alias("dm"), V.masked_l1(q, c, F.col("weight"), D).alias("dw"))
    fit = own.groupBy("unit").agg(B.ceil_percentile(F.col("dm"), 95).alias("rm"), B.ceil_percentile(F.col("dw"), 95).alias("rw"), F.rint(F.median("dw")).cast("long").alias("theta"))
    rows = B.met(second, full.join(fit, "unit"), {"dm": lambda u: V.masked_l1(q, u["centroid"], u["mask"], D), "dw": lambda u: V.masked_l1(q, u["centroid"], u["weight"], D), "rm": lambda u: u["rm"], "rw": lambda u: u["rw"], "theta": lambda u: u["theta"]})
    n = lambda f: F.size(F.filter("rows", f)).cast("long")
    return rows.select("vec_id", n(lambda r: r["dm"] <= r["rm"]).alias("masked"), n(lambda r: r["dw"] <= r["rw"]).alias("weighted"), B.nearest("rows", lambda r: r["dw"] - r["theta"])["unit"].alias("wta"), F.exists("rows", lambda r: (r["unit"] == F.col("unit")) & (r["dw"] <= r["rw"])).cast("int").alias("hit"))


@query(BASE + """, tile AS (SELECT vec_id, unit, ntile(4) OVER (PARTITION BY unit ORDER BY t, vec_id) AS p FROM (SELECT DISTINCT vec_id, unit, t FROM fitc)),
pc AS (SELECT tile.unit, p, d, CAST(round_even(avg(c), 0) AS BIGINT) AS m FROM tile JOIN fitc f ON f.vec_id = tile.vec_id GROUP BY tile.unit, p, d),
po AS (SELECT tile.vec_id, tile.unit, tile.p, sum(abs(c - m)) AS dist FROM tile JOIN fitc f ON f.vec_id = tile.vec_id JOIN pc ON pc.unit = tile.unit AND pc.p = tile.p AND pc.d = f.d GROUP BY tile.vec_id, tile.unit, tile.p),
pr AS (SELECT unit, p, ceil(round(quantile_cont(dist, 0.95), 9)) AS r FROM po GROUP BY unit, p),
pp AS (SELECT vec_id, pc.unit AS u, pc.p, sum(abs(c - m)) AS dist FROM testc t JOIN pc ON pc.d = t.d GROUP BY vec_id, pc.unit, pc.p)
SELECT vec_id, count(*) FILTER (WHERE dist <= r) AS hits, count(DISTINCT u) FILTER (WHERE dist <= r) AS candidates FROM pp JOIN pr ON pr.unit = u AND pr.p = pp.p GROUP BY vec_id""")
def a12_j11_prototypes(spark, sf_dir):
    """Four temporal prototypes of each unit, and units found through any, each once."""
    first, second, _ = fitted(spark, sf_dir)
    tiled = first.withColumn("p", F.ntile(4).over(Window.partitionBy("unit").orderBy("t", "vec_id")))
    bank = B.centroids(tiled, D, by=["unit", "p"])
    own = tiled.join(bank.select("unit", "p", "centroid"), ["unit", "p"]).groupBy("unit", "p").agg(B.ceil_percentile(distance(F.col("q"), F.col("centroid")), 95).alias("radius"))
    bank = B.numbered(bank.join(own, ["unit", "p"]), "unit", "p")
    rows = B.met(second, bank, {"in": lambda u: distance(F.col("q"), u["centroid"]) <= u["radius"]})
    return rows.select("vec_id", F.size(F.filter("rows", lambda r: r["in"])).cast("long").alias("hits"), F.size(B.units_where("rows", lambda r: r["in"])).cast("long").alias("candidates"))


@query(BASE + """, g AS (SELECT vec_id, cen.unit AS u, sum(c * m) / (sqrt(sum(c * c)) * sqrt(sum(m * m))) AS s, sum(abs(c - m)) AS dist FROM testc t JOIN cen ON cen.d = t.d GROUP BY vec_id, cen.unit),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, u) AS rc, row_number() OVER (PARTITION BY vec_id ORDER BY dist, u) AS rl FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY 7 * rc + 3 * rl, u) AS rf FROM k)
SELECT vec_id, count(*) FILTER (WHERE round(1 - s, 9) <= 0.1) AS in_cosine, string_agg(CAST(u AS VARCHAR), ',' ORDER BY rf) FILTER (WHERE rf <= 3) AS fused, string_agg(CAST(u AS VARCHAR), ',' ORDER BY rl) FILTER (WHERE rl <= 4) AS nearest4 FROM f GROUP BY vec_id""")
def j12_w10_cosine_and_fusion(spark, sf_dir):
    """Cosine radius, top four by distance, fusion of two ranks."""
    _, second, bank = fitted(spark, sf_dir)
    rows = B.met(second, bank, {"s": lambda u: F.round(V.cosine(F.col("q"), u["centroid"]), 9), "d": lambda u: distance(F.col("q"), u["centroid"])})
    by_l1 = F.array_sort(F.transform("rows", lambda r: F.struct(r["d"].alias("k"), r["unit"].alias("unit"))))
    by_cos = F.array_sort(F.transform("rows", lambda r: F.struct((-r["s"]).alias("k"), r["unit"].alias("unit"))))
    out = rows.withColumns({"l": F.transform(by_l1, lambda x: x["unit"]), "c": F.transform(by_cos, lambda x: x["unit"])})
    fused = F.array_sort(F.transform("l", lambda u: F.struct((F.array_position("c", u) * 7 + F.array_position("l", u) * 3).alias("k"), u.alias("unit"))))
    return out.select("vec_id", F.size(F.filter("rows", lambda r: F.round(1 - r["s"], 9) <= 0.1)).cast("long").alias("in_cosine"), text(F.slice(F.transform(fused, lambda x: x["unit"]), 1, 3)).alias("fused"), text(F.slice("l", 1, 4)).alias("nearest4"))


@query(BASE + """, sc AS (SELECT vec_id, unit, t, d, CAST(round_even(least(greatest(x, -1), 1) * 15, 0) AS BIGINT) AS c FROM lane),
su AS (SELECT unit, d, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM sc, cut WHERE t <= ct GROUP BY unit, d),
tm AS (SELECT unit, d, CAST(sign(s) * (abs(s) // n + CASE WHEN (abs(s) % n) * 2 > n OR ((abs(s) % n) * 2 = n AND (abs(s) // n) % 2 = 1) THEN 1 ELSE 0 END) AS BIGINT) AS m FROM su),
cand AS (SELECT vec_id, u FROM pair JOIN rad ON rad.unit = u WHERE dist <= r), nn AS (SELECT vec_id, truth, arg_min(u, dist * 1000 + u) AS u0 FROM pair GROUP BY vec_id, truth),
sad AS (SELECT cand.vec_id, cand.u, sum(abs(c - m)) AS s FROM cand JOIN sc ON sc.vec_id = cand.vec_id JOIN tm ON tm.unit = cand.u AND tm.d = sc.d GROUP BY cand.vec_id, cand.u),
best AS (SELECT vec_id, arg_min(u, s * 1000 + u) AS u1, count(*) AS n FROM sad GROUP BY vec_id)
SELECT nn.vec_id, truth, CAST(coalesce(u1, u0) AS INTEGER) AS pred, CAST(CASE WHEN coalesce(n, 0) > 1 THEN n ELSE 0 END AS BIGINT) AS reads, n IS NULL AS fallback FROM nn LEFT JOIN best ON best.vec_id = nn.vec_id""")
def a3_j19_candidate_refinement(spark, sf_dir):
    """Exact integer templates; only candidates' templates are read, none for a single candidate, and
    the nearest row stands in without any."""
    first, second, bank = fitted(spark, sf_dir)
    wave = F.array(*[V.quantize_signed(F.col("w")[i], 5) for i in range(WAVE)])
    sums = first.withColumn("s", wave).groupBy("unit").agg(F.count(F.lit(1)).alias("k"), F.array(*[F.sum(F.col("s")[i]) for i in range(WAVE)]).alias("s"))
    templates = sums.select("unit", F.transform("s", lambda x: divide_half_even(x, F.col("k"))).alias("template"))
    rows = B.met(second.withColumn("v", wave), bank.join(templates, "unit"), {"d": lambda u: distance(F.col("q"), u["centroid"]), "in": lambda u: distance(F.col("q"), u["centroid"]) <= u["radius"], "sad": lambda u: F.when(distance(F.col("q"), u["centroid"]) <= u["radius"], V.array_sum(F.zip_with(F.col("v"), u["template"], lambda a, b: F.abs(a - b)), "long"))})
    inside = F.filter("rows", lambda r: r["in"])
    n = F.size(inside)
    pred = F.when(n > 0, B.nearest(inside, lambda r: r["sad"])["unit"]).otherwise(B.nearest("rows", lambda r: r["d"])["unit"])
    return rows.select("vec_id", F.col("unit").alias("truth"), pred.alias("pred"), F.when(n > 1, n).otherwise(0).cast("long").alias("reads"), (n == 0).alias("fallback"))


@query(BOX + """, i AS (SELECT bp.vec_id, bp.truth, u, need, dist <= r AS o FROM bp JOIN rad ON rad.unit = u), n AS (SELECT vec_id, count(*) FILTER (WHERE need = 0) AS k FROM i GROUP BY vec_id)
SELECT i.vec_id, CASE WHEN k = 1 THEN min(CAST(u AS VARCHAR)) FILTER (WHERE need = 0) ELSE coalesce(string_agg(CAST(u AS VARCHAR), ',' ORDER BY CASE WHEN o THEN 0 ELSE 1 END, u) FILTER (WHERE o OR need = 0), '') END AS candidates, k = 1 AS early FROM i JOIN n ON n.vec_id = i.vec_id GROUP BY i.vec_id, k""")
def j22_w11_dual_range(spark, sf_dir):
    """A single inner box ends the search, else outer then inner candidates, each once."""
    _, second, bank = boxed(spark, sf_dir)
    rows = B.met(second, bank, {"box": lambda u: B.inside_box(u, F.col("q"), D), "in": lambda u: distance(F.col("q"), u["centroid"]) <= u["radius"]})
    inner, outer = B.units_where("rows", lambda r: r["box"]), B.units_where("rows", lambda r: r["in"])
    both = F.concat(outer, F.filter(inner, lambda u: ~F.array_contains(outer, u)))
    return rows.select("vec_id", text(F.when(F.size(inner) == 1, inner).otherwise(both)).alias("candidates"), (F.size(inner) == 1).alias("early"))


@query(BOX + """, s AS (SELECT vec_id, truth, min(u) FILTER (WHERE need = 0) AS pred FROM bp GROUP BY vec_id, truth HAVING count(*) FILTER (WHERE need = 0) = 1),
c AS (SELECT pred AS unit, count(*) AS support, count(*) FILTER (WHERE pred = truth) AS correct FROM s GROUP BY pred)
SELECT cen.unit, coalesce(support, 0) AS support, coalesce(correct, 0) AS correct, round(CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE (correct * 1.0 / support + 1.645 * 1.645 / (2 * support) - 1.645 * sqrt((correct * 1.0 / support * (1 - correct * 1.0 / support) + 1.645 * 1.645 / (4 * support)) / support)) / (1 + 1.645 * 1.645 / support) END, 6) AS wilson
FROM (SELECT DISTINCT unit FROM cen) cen LEFT JOIN c ON c.unit = cen.unit""")
def a21_a22_certify(spark, sf_dir):
    """Single inner candidates by predicted unit, with the Wilson lower bound of their accuracy."""
    from spindrift.operators.metrics import wilson_lower

    _, second, bank = boxed(spark, sf_dir)
    rows = B.met(second, bank, {"box": lambda u: B.inside_box(u, F.col("q"), D)})
    single = rows.select("unit", B.units_where("rows", lambda r: r["box"]).alias("c")).where(F.size("c") == 1)
    counted = single.select(F.try_element_at("c", F.lit(1)).alias("pred"), F.col("unit").alias("truth")).groupBy(F.col("pred").alias("unit")).agg(F.count(F.lit(1)).alias("support"), F.count(F.when(F.col("pred") == F.col("truth"), 1)).alias("correct"))
    out = bank.select("unit").join(counted, "unit", "left").na.fill(0)
    return out.withColumn("wilson", F.round(wilson_lower(F.col("correct"), F.col("support")), 6))


@query(BASE + """, ap AS (SELECT o.vec_id, o.unit, arg_min(cen.unit, d2 * 1000 + cen.unit) AS anchor FROM (SELECT f.vec_id, f.unit, cen.unit AS u, sum(abs(c - m)) AS d2 FROM fitc f JOIN cen ON cen.d = f.d GROUP BY f.vec_id, f.unit, cen.unit) o JOIN (SELECT DISTINCT unit FROM cen) cen ON cen.unit = o.u GROUP BY o.vec_id, o.unit),
cc AS (SELECT anchor, unit, count(*) AS n FROM ap GROUP BY anchor, unit),
g AS (SELECT *, sum(n) OVER (PARTITION BY anchor ORDER BY n DESC, unit ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY anchor) AS tot FROM cc)
SELECT CAST(anchor AS INTEGER) AS anchor, string_agg(CAST(unit AS VARCHAR), ',' ORDER BY n DESC, unit) AS units, CAST(sum(n) AS BIGINT) AS covered FROM g WHERE cum - n < ceil(tot * 0.8) GROUP BY anchor""")
def a20_anchor_graph(spark, sf_dir):
    """Units confused with an anchor (the nearest row), the most frequent ones up to 0.8 of its events."""
    first, _, bank = fitted(spark, sf_dir)
    near = B.met(first, bank, {"d": lambda u: distance(F.col("q"), u["centroid"])}).select("unit", B.nearest("rows", lambda r: r["d"])["unit"].alias("anchor"))
    kept = O.minimal_coverage(near.groupBy("anchor", "unit").agg(F.count(F.lit(1)).alias("n")), ["anchor"], "n", "unit", 0.8)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "unit")))
    return kept.groupBy("anchor").agg(text(F.transform(order, lambda x: x["unit"])).alias("units"), F.sum("n").alias("covered"))


@query(BASE + """, st AS (SELECT unit, d, count(*) AS n, avg(c) AS mean, var_pop(c) AS v FROM fitc GROUP BY unit, d HAVING count(*) >= 10), gm AS (SELECT d, sum(n * mean) / sum(n) AS g FROM st GROUP BY d),
f AS (SELECT st.d, sum(n * (mean - g) * (mean - g)) AS b, sum(n * v) AS w FROM st JOIN gm ON gm.d = st.d GROUP BY st.d)
SELECT d, round(b / (w + 1e-12), 6) AS fisher, CAST(row_number() OVER (ORDER BY round(b / (w + 1e-12), 6) DESC, d) AS BIGINT) AS rank FROM f""")
def a13_a14_fisher(spark, sf_dir):
    """Between and within sums of squares of units with at least ten events, ranked."""
    first, _, _ = fitted(spark, sf_dir)
    lanes = first.select("unit", F.posexplode("q").alias("d", "c"))
    s = lanes.groupBy("unit", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.var_pop("c").alias("v")).where("n >= 10")
    g = s.groupBy("d").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g"))
    f = s.join(g, "d").groupBy("d").agg(F.sum(F.col("n") * (F.col("mean") - F.col("g")) * (F.col("mean") - F.col("g"))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    scored = f.select(F.col("d").cast("long").alias("d"), F.round(F.col("b") / (F.col("w") + 1e-12), 6).alias("fisher"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fisher"), "d")).cast("long"))  # as many rows as lanes


@query(BASE + """, s AS (SELECT unit, d, count(*) AS n, avg(c) AS mean, var_pop(c) * count(*) AS ss FROM fitc GROUP BY unit, d),
p AS (SELECT a.unit AS u, b.unit AS v, a.d, (a.mean - b.mean) * (a.mean - b.mean) * a.n * b.n / (a.n + b.n) / greatest(a.ss + b.ss, 1e-12) AS f FROM s a JOIN s b ON a.d = b.d AND a.unit < b.unit)
SELECT u, v, string_agg(CAST(d AS VARCHAR), ',' ORDER BY k) AS taps FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY round(f, 9) DESC, d) AS k FROM p) WHERE k <= 3 GROUP BY u, v""")
def a15_pair_taps(spark, sf_dir):
    """For each pair of units, the three lanes that tell them apart best."""
    first, _, _ = fitted(spark, sf_dir)
    s = first.select("unit", F.posexplode("q").alias("d", "c")).groupBy("unit", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), (F.var_pop("c") * F.count(F.lit(1))).alias("ss"))
    a, b = s.select(F.col("unit").alias("u"), "d", F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("ss").alias("s1")), s.select(F.col("unit").alias("v"), "d", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("ss").alias("s2"))
    gap = F.col("m1") - F.col("m2")
    p = a.join(b, "d").where("u < v").withColumn("f", F.round(gap * gap * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) / F.greatest(F.col("s1") + F.col("s2"), F.lit(1e-12)), 9))
    kept = O.ranked(p, ["u", "v"], [F.desc("f"), "d"], "k").where("k <= 3")
    return kept.groupBy("u", "v").agg(text(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"])).alias("taps"))


@query(BASE + """, n AS (SELECT vec_id, truth, arg_min(u, dist * 1000 + u) AS pred, count(*) FILTER (WHERE dist <= r) AS c, max(CASE WHEN dist <= r AND u = truth THEN 1 ELSE 0 END) AS hit FROM pair JOIN rad ON rad.unit = u GROUP BY vec_id, truth)
SELECT count(*) AS n, round(avg(hit), 6) AS recall, round(avg(CASE WHEN c = 0 THEN 1.0 ELSE 0 END), 6) AS zero, round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 6) AS single, round(avg(CASE WHEN c > 1 THEN 1.0 ELSE 0 END), 6) AS ambiguous, round(avg(c), 6) AS mean_c, round(quantile_cont(c, 0.95), 6) AS p95_c, max(c) AS max_c,
  round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0 END), 6) AS accuracy, round(CASE WHEN sum(CASE WHEN c > 1 THEN c ELSE 0 END) = 0 THEN CAST('inf' AS DOUBLE) ELSE count(*) * 10.0 / sum(CASE WHEN c > 1 THEN c ELSE 0 END) END, 6) AS reduction FROM n""")
def r1_r2_candidate_metrics(spark, sf_dir):
    """Recall, candidate counts, accuracy and read reduction of the range search."""
    _, second, bank = fitted(spark, sf_dir)
    rows = B.met(second, bank, {"d": lambda u: distance(F.col("q"), u["centroid"]), "in": lambda u: distance(F.col("q"), u["centroid"]) <= u["radius"]})
    x = rows.select("unit", F.size(F.filter("rows", lambda r: r["in"])).alias("c"), F.exists("rows", lambda r: r["in"] & (r["unit"] == F.col("unit"))).cast("int").alias("hit"), B.nearest("rows", lambda r: r["d"])["unit"].alias("pred"), F.size("rows").alias("u"))
    share = lambda p: F.round(F.avg(p.cast("double")), 6)
    c, reads = F.col("c"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("recall"), share(c == 0).alias("zero"), share(c == 1).alias("single"), share(c > 1).alias("ambiguous"), F.round(F.avg("c"), 6).alias("mean_c"), F.round(F.percentile("c", F.lit(0.95)), 6).alias("p95_c"), F.max(c.cast("long")).alias("max_c"), share(F.col("pred") == F.col("unit")).alias("accuracy"), F.round(F.when(reads == 0, float("inf")).otherwise(F.sum("u") / reads), 6).alias("reduction"))


@query(BASE + """, n AS (SELECT vec_id, truth, arg_min(u, dist * 1000 + u) AS pred FROM pair GROUP BY vec_id, truth) SELECT CAST(pred AS INTEGER) AS pred, truth, count(*) AS n FROM n GROUP BY pred, truth""")
def j31_confusion(spark, sf_dir):
    """The confusion matrix of nearest rows and labels."""
    _, second, bank = fitted(spark, sf_dir)
    rows = B.met(second, bank, {"d": lambda u: distance(F.col("q"), u["centroid"])})
    return rows.select(B.nearest("rows", lambda r: r["d"])["unit"].alias("pred"), F.col("unit").alias("truth")).groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + """, o AS (SELECT vec_id, t.unit, sum(abs(c - m)) AS dist FROM testc t JOIN cen ON cen.unit = t.unit AND cen.d = t.d GROUP BY vec_id, t.unit)
SELECT o.unit, count(*) AS n, round(avg(CASE WHEN dist <= r THEN 1.0 ELSE 0 END), 6) AS inside, CAST(max(dist - r) AS BIGINT) AS worst, round(quantile_cont(dist, 0.9), 6) AS p90 FROM o JOIN rad ON rad.unit = o.unit GROUP BY o.unit""")
def r8_r9_unit_recall(spark, sf_dir):
    """By unit, how far its own events lie from its centroid, against its radius."""
    _, second, bank = fitted(spark, sf_dir)
    own = B.with_own(second, bank, "centroid", "radius").select("unit", "radius", distance(F.col("q"), F.col("centroid")).alias("d"))
    return own.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("d") <= F.col("radius")).cast("double")), 6).alias("inside"), F.max(F.col("d") - F.col("radius")).alias("worst"), F.round(F.percentile("d", F.lit(0.9)), 6).alias("p90"))
