"""Approximate nearest neighbours by multi-index hashing.

Several learned rotations (ITQ, each from its own start) give a code of ``TABLES`` substrings of ``BITS`` bits. Every
substring is the key of a global table: its first bits name a group of rows, its last bits a bucket within the group.
With a radius of t bits a substring, all buckets within t bits of a query's are probed in each table. By the pigeonhole
principle this retrieves every code within ``TABLES * (t + 1) - 1`` bits, and most beyond it; codes found are held to
a radius over the whole code, each pair under the first table in which it meets, and their original vectors are
reranked by Euclidean distance in double precision.

The radius grows until the k-th neighbour is settled. On the bounded sample that the rotations are fitted on, the
distances below which pairs are retrieved at a share of ``SURE`` are measured for each t; a query is settled once its
k-th neighbour found lies within that distance, and searches on with a larger t otherwise, its radius over the whole
code being that of the distance of the k-th found so far. At t = ``BITS`` every bucket
is probed, so as many neighbours as there are come out.

Equal vectors are one class with its smallest ids, so copies meet once however many there are. Groups of the tables
hold about ``ROWS`` rows: their number grows with the table, and a group that is larger all the same (near copies) is
dealt out in parts. A task holds the rows of one part; queries pass by.

Defined cases: vectors that are null, empty, zero, have null or non-finite parts, or a length other than most
of the fitted sample, take no part, as query or candidate; ties go to the smaller id; with fewer candidates
than ``k`` all are returned; a repeated query row with the same id is one query; a row that repeats the query's
id isn't a candidate of it; repeated rows are one candidate; null ids take no part; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm import itq
from spindrift.llm._store import materialise

#: Substrings of a code and bits of each.
TABLES, BITS = 24, 16
#: Rows of a group of a table, about; and at most, before it is dealt out in parts.
ROWS, MOST_ROWS = 2048, 16384
#: Share of near pairs of the sample that a radius must retrieve to settle queries at their distance.
SURE = 0.95
#: Queries of the sample by which radii are measured.
_TRIED = 256


@dataclass(frozen=True)
class Codes:
    """Rotations whose bits, one after another, are cut into substrings."""

    rotations: tuple[itq.Itq, ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        """(n, TABLES) substrings."""
        bits = np.hstack([m.project(x) > 0 for m in self.rotations])[:, : TABLES * BITS]
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def fit_codes(x: np.ndarray) -> Codes:
    rotations, bits = [], 0
    while bits < TABLES * BITS:
        rotations.append(itq.fit(x, seed=7 + len(rotations)))
        bits += rotations[-1].bits
    return Codes(tuple(rotations))


@dataclass(frozen=True)
class Radii:
    """``reach[t]``: the distance up to which probing t bits retrieves pairs as surely as ``SURE``. ``steps`` and
    ``whole``: growing distances, and the radius over the whole code that holds nearly all pairs up to each. ``start``,
    ``first``: the t to begin with, and the distance that the k-th neighbour hardly exceeds."""

    reach: np.ndarray
    steps: np.ndarray
    whole: np.ndarray
    start: int
    first: float

    def radius(self, distance: F.Column) -> F.Column:
        """Over the whole code, for pairs up to a distance (null: any)."""
        out = F.lit(TABLES * BITS)
        for d, w in reversed(list(zip(self.steps.tolist(), self.whole.tolist(), strict=True))):
            out = F.when(distance <= d, F.lit(int(w))).otherwise(out)
        return out


def measure_radii(codes: Codes, x: np.ndarray, rows: int, k: int) -> Radii:
    """From pairs of the sample. ``rows``: those of the whole table, which says how near the k-th neighbour will be."""
    reach = np.full(BITS + 1, -1.0)
    reach[BITS] = np.inf
    tried = np.unique(np.linspace(0, len(x) - 1, min(_TRIED, len(x))).astype(int))
    sub, square = codes.of(x), (x * x).sum(axis=1)
    distance = np.sqrt(np.maximum(square[tried][:, None] + square[None, :] - 2 * x[tried] @ x.T, 0))
    least, total = np.full(distance.shape, BITS, dtype=np.uint8), np.zeros(distance.shape, dtype=np.uint16)
    for table in range(TABLES):
        differ = np.bitwise_count(sub[tried, table][:, None] ^ sub[None, :, table])
        np.minimum(least, differ, out=least)
        total += differ
    # The k-th neighbour in the whole table is about as far as this one in the sample; the median isn't moved by copies.
    place = min(len(x) - 1, max(1, int(np.ceil(k * len(x) / max(rows, 1)))))
    distance[np.arange(len(tried)), tried] = -1.0  # itself comes first
    expected = float(np.median(np.partition(distance, place, axis=1)[:, place]))
    pairs = np.ones(distance.shape, dtype=bool)
    pairs[np.arange(len(tried)), tried] = False
    distance, least, total = distance[pairs], least[pairs], total[pairs]
    if not len(distance):
        return Radii(reach, np.zeros(0), np.zeros(0, int), BITS, np.inf)
    order = np.argsort(distance, kind="stable")
    distance, least, total = distance[order], least[order], total[order]
    numbers = np.arange(1, len(distance) + 1)
    for t in range(BITS):
        sure = np.flatnonzero(np.cumsum(least <= t) >= SURE * numbers)
        if len(sure):
            reach[t] = distance[sure[-1]]
    ends = np.unique(np.minimum(len(distance), 64 * 1.3 ** np.arange(60)).astype(int))
    whole = np.maximum.accumulate([int(np.quantile(total[:n], 0.99)) for n in ends])
    start = int(np.flatnonzero(reach >= min(expected, reach[:BITS].max()))[0])
    return Radii(reach, distance[ends - 1], whole, start, 1.03 * expected)


# ------------------------------------------------------------------ within a group


def probe(rest: np.ndarray, starts: np.ndarray, values: np.ndarray, asked: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows in buckets within ``left`` bits of each query's bucket. ``values``: the buckets that
    hold rows, ``starts``: where each one's rows start in ``rest``, which is sorted."""
    near = np.bitwise_count(asked[:, None] ^ values[None, :]) <= left[:, None]
    query, bucket = np.nonzero(near)
    sizes = np.diff(np.r_[starts, len(rest)])[bucket]
    first = np.repeat(starts[bucket] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.zeros(0, np.int64)
    return np.repeat(query, sizes), first + np.arange(int(sizes.sum()))


class _Group:
    """The rows of one part of one group of a table."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, table: int, lead: int):
        rest = codes[:, table] >> np.uint16(lead)
        order = np.argsort(rest, kind="stable")
        self.ids, self.codes, self.rest, self.table, self.lead = ids[order], codes[order], rest[order], table, lead
        self.values, self.starts = np.unique(self.rest, return_index=True)

    def meet(self, ids: np.ndarray, codes: np.ndarray, whole: np.ndarray, first_bits: int, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, row) that meet under no earlier table and lie within the whole radius."""
        own = codes[:, self.table]
        mask = np.uint16((1 << self.lead) - 1)
        left = t - np.bitwise_count((own & mask) ^ np.uint16(first_bits)).astype(int)
        for k in range(0, len(ids), 64):
            q, r = probe(self.rest, self.starts, self.values, own[k : k + 64] >> np.uint16(self.lead), left[k : k + 64])
            for s in range(0, len(q), 200_000):
                a, b = q[s : s + 200_000] + k, r[s : s + 200_000]
                differ = np.bitwise_count(codes[a] ^ self.codes[b])
                kept = (differ.sum(axis=1) <= whole[a]) & ((differ <= t).argmax(axis=1) == self.table)
                if kept.any():
                    yield ids[a[kept]], self.ids[b[kept]]


def _meet(batches: Iterator[pa.RecordBatch], lead: int, t: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (table, first, part, asked): rows of a part, then the queries that probe it."""
    at, held, group = None, [], None
    for b in batches:
        spot = np.stack([b.column(i).to_numpy() for i in range(3)])
        asked, ids = b.column(3).to_numpy(), b.column(4).to_numpy()
        codes = np.ascontiguousarray(b.column(5).flatten().to_numpy()).view("<u2").reshape(b.num_rows, TABLES)
        whole = b.column(6).to_numpy()
        cuts = [0, *(np.flatnonzero((spot[:, 1:] != spot[:, :-1]).any(axis=0) | (asked[1:] != asked[:-1])) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            here = tuple(spot[:, s].tolist())
            if here != at:
                at, held, group = here, [], None
            if not asked[s]:
                held.append((ids[s:e], codes[s:e]))
            elif held:
                group = group or _Group(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), here[0], lead)
                for q, v in group.meet(ids[s:e], codes[s:e], whole[s:e], here[1], t):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v)], ["q", "v"])


# ------------------------------------------------------------------ Spark


def _coded(classes: DataFrame, codes: Codes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                words = codes.of(itq.matrix(part.column(1))).view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(words), pa.list_(pa.int64()))], ["cls", "code"])

    return classes.select("cls", "vector").mapInArrow(run, "cls long, code array<long>")


def _posted(coded: DataFrame, lead: int) -> DataFrame:
    """table, first (the first bits of the substring) of every row in every table."""
    substrings = []
    for table in range(TABLES):
        word, shift = divmod(table * BITS, 64)
        substrings.append(F.struct(F.lit(table).alias("table"), F.shiftrightunsigned(F.col("code")[word], shift).bitwiseAND(F.lit((1 << lead) - 1)).cast("int").alias("first")))
    return coded.select(*coded.columns, F.inline(F.array(*substrings)))


def _pairs(posts: DataFrame, asked: DataFrame, lead: int, t: int) -> DataFrame:
    """q and v: classes of queries, and the classes that probing t bits finds within a query's radius over the whole
    code (``whole``)."""
    counts = posts.groupBy("table", "first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS)
    parts = materialise(counts.select("table", "first", F.ceil(F.col("n") / MOST_ROWS).cast("int").alias("parts")), "parts")
    n = F.coalesce("parts", F.lit(1))
    rows = posts.join(parts, ["table", "first"], "left").select("table", "first", F.pmod(F.xxhash64("cls"), n).cast("int").alias("part"), F.lit(0).alias("asked"), "cls", "code", F.lit(0).alias("whole"))
    flips = [m for m in range(1 << lead) if m.bit_count() <= t]
    probes = _posted(asked, lead).select("table", F.explode(F.transform(F.array(*[F.lit(m) for m in flips]), lambda m: F.col("first").bitwiseXOR(m))).alias("first"), "cls", "code", "whole")
    probes = probes.join(parts, ["table", "first"], "left").select("table", "first", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), F.lit(1).alias("asked"), "cls", "code", "whole")
    spot = ["table", "first", "part"]
    return rows.unionByName(probes).repartition(*spot).sortWithinPartitions(*spot, "asked").mapInArrow(lambda it: _meet(it, lead, t), "q long, v long")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = itq.SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id (long), rank (int, from 1), vec_id (long), score (double) for each usable row of ``queries``."""

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(itq.usable(F.col("vector")) & F.col("id").isNotNull())

    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    x = itq.sample_table(usable(vectors), "id", "vector", sample)
    if x is None:
        return spark.createDataFrame([], schema)
    codes, fits = fit_codes(x), F.size("vector") == x.shape[1]
    # A class's smallest ids are all that can be among k neighbours.
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    few = usable(vectors).where(fits).withColumn("place", place).where(F.col("place") <= k + 1)
    grouped = few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = materialise(grouped.select(F.col("ids")[0].alias("cls"), "vector", "ids"), "classes")
    named = usable(queries).where(fits).join(classes.select("cls", "vector"), "vector").groupBy("id").agg(F.min("cls").alias("q"))
    named = materialise(named, "queries")
    rows = classes.count()
    radii, lead = measure_radii(codes, x, rows, k), min(12, max(0, round(np.log2(max(rows, 1) / ROWS))))
    coded = materialise(_coded(classes, codes), "codes")
    posts = _posted(coded, lead)
    open_ = coded.join(named.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi").withColumn("limit", F.lit(radii.first))

    wide = F.transform("vector", lambda v: v.cast("double"))
    candidates = classes.select(F.col("cls").alias("v"), wide.alias("vx"), "ids")
    asked = classes.join(named.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("q"), wide.alias("qx"))
    gap = F.sqrt(F.aggregate(F.zip_with("qx", "vx", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y))
    nearest = Window.partitionBy("q").orderBy("score", "v")
    found, t = None, radii.start
    while True:
        met = _pairs(posts, open_.withColumn("whole", radii.radius(F.col("limit"))), lead, t).join(candidates, "v").join(asked, "q").select("q", "v", "ids", gap.alias("score"))
        top = materialise(met.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1), "nearest")
        # The k-th neighbour is where the classes found hold k ids beside the query's own.
        held = top.withColumn("held", F.sum(F.size("ids")).over(nearest))
        kth = held.groupBy("q").agg(F.min(F.when(F.col("held") > k, F.col("score"))).alias("kth"))
        judged = materialise(open_.drop("code").join(kth, open_["cls"] == kth["q"], "left").select("cls", "kth", "limit"), "judged")
        sure = (F.col("kth") <= F.col("limit")) & (F.col("kth") <= float(radii.reach[t]))
        settled = judged.where(F.lit(t == BITS) | F.coalesce(sure, F.lit(False))).select(F.col("cls").alias("q"))
        done = top.join(settled, "q", "left_semi")
        found = done if found is None else found.unionByName(done)
        # What was found bounds the k-th neighbour's distance: the next round looks no further.
        later = judged.join(settled, judged["cls"] == settled["q"], "left_anti").select("cls", F.coalesce("kth", F.lit(float("inf"))).alias("limit"))
        open_ = materialise(open_.drop("limit").join(later, "cls"), "open")
        if t == BITS or open_.isEmpty():
            break
        t += 1
    each = named.join(found, "q").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
