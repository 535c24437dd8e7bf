"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 of every word shingle, and per bit the majority. Equal fingerprints are one class. Two
classes within ``radius`` bits agree in whole on at least ``SEGMENTS - radius`` of the segments of the 64
bits, so they meet under one of the keys made of that many segments: no link is lost. Classes under a key
are compared in vertical form: bit plane p of a block holds bit p of 64 fingerprints a word; one XOR of planes
gives a bit of 64 differences, carry-save counters add them up, and a block is abandoned once all its
distances exceed the radius. A key with more classes than a block is cut into blocks, and each pair of
blocks is a task's work of its own. A task reports a spanning forest of what it links, not all pairs.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and are linked like any
others; fewer words than a shingle are one shingle; null ids are kept and are smallest in their component only
if no other id is there; repeated rows are rows of the same class; an empty table gives an empty result; other
columns are ignored by :func:`fingerprints` and pass through :func:`near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm._store import materialise, release, scope
from spindrift.llm.components import connected_components

SEGMENTS = 5
#: Largest number of classes of one key that are compared in one block.
BLOCK = 1024


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes: only A-Z fall, only ASCII white space splits
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bit b of the result is set if it is in over half of ``h``: counted by carry-save adders over bit-sliced
    words, then by a byte table."""
    n, total = len(h), np.zeros(64, dtype=np.int64)
    while len(h) >= 96:  # three words to a sum and a carry of twice the weight: the counts stay, the words shrink
        levels, weight = [h], 1
        total_of: list[tuple[int, np.ndarray]] = []
        while levels[0] is not None and len(levels[0]) >= 3:
            x = levels[0]
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            ab = a ^ b
            total_of.append((weight, np.concatenate([ab ^ c, x[3 * k :]])))
            levels, weight = [(a & b) | (ab & c)], weight * 2
        total_of.append((weight, levels[0]))
        for w, x in total_of:
            total += w * _bit_counts(x)
        h = h[:0]
    if len(h):
        total += _bit_counts(h)
    bits = np.flatnonzero(total * 2 > n)
    return sum(1 << int(b) for b in bits)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (long: the 64 bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]))


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane p is bit p of fingerprint 64 * w + i."""
    n = -(-len(fp) // 64) * 64
    padded = np.zeros(n, dtype="<u8")
    padded[: len(fp)] = fp.view(np.uint64)
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def within(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with at most ``radius`` differing bits between left[i] and right[j].

    The counters are ``levels`` words a pair of (left, 64 rights): adding a plane's differences ripples through
    them; ``over`` keeps what has overflowed or exceeds the radius at a look.
    """
    vertical = planes(right)
    levels = max(1, radius.bit_length())
    found_i, found_j = [], []
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256].view(np.uint64)
        alive = np.arange(len(rows))
        counts = np.zeros((levels, len(rows), vertical.shape[1]), dtype=np.uint64)
        over = np.zeros((len(rows), vertical.shape[1]), dtype=np.uint64)
        for p in range(64):
            flip = np.where((rows[alive] >> np.uint64(p)) & np.uint64(1), ones, np.uint64(0))
            carry = vertical[p][None, :] ^ flip[:, None]
            for c in counts:
                c_new = c ^ carry
                np.bitwise_and(c, carry, out=carry)
                c[...] = c_new
            over |= carry
            if p % 8 == 7 and p < 63:  # abandon rows of words in which all distances exceed the radius
                beyond = over | _exceeds(counts, radius)
                keep = ~np.all(beyond == ones, axis=1)
                if not keep.all():
                    if not keep.any():
                        alive = alive[:0]
                        break
                    alive, counts, over = alive[keep], np.ascontiguousarray(counts[:, keep]), over[keep]
        if not len(alive):
            continue
        ok = ~(over | _exceeds(counts, radius))
        i, w = np.nonzero(ok)
        bits = np.unpackbits(ok[i, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        j = w[k] * 64 + bit
        real = j < len(right)
        found_i.append(alive[i[k[real]]] + at)
        found_j.append(j[real])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def _exceeds(counts: np.ndarray, radius: int) -> np.ndarray:
    """Where the number in the counter words is over ``radius``: the comparison bit by bit from the highest."""
    above = np.zeros_like(counts[0])
    equal = ~above
    for level in range(len(counts) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counts[level]
        else:
            above |= equal & counts[level]
            equal &= ~counts[level]
    return above


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between 0..n-1, each linked vertex with the smallest one of its component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _segment_keys(fp: F.Column, radius: int) -> list:
    """One 64-bit key for each choice of segments that must agree; the choice's number is in the hash."""
    edges = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(SEGMENTS), SEGMENTS - radius)):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in choice)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(number)))
    return keys


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, left, right): each group is one block, or two blocks to compare with each other.
    Row: key, left, right (block numbers of the pair), own (block of this row), fp."""
    rest = None
    names = ["a", "b"]

    def groups(key: np.ndarray, left, right, own, fp) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1
        starts = np.r_[0, new]
        sizes = np.diff(np.r_[starts, len(key)])
        outs_a, outs_b = [], []
        small = (sizes <= 64) & (left[starts] == right[starts])
        # Small groups: shifts of the whole run of rows, all groups at once.
        if small.any():
            rows = np.repeat(small, sizes)
            group = np.repeat(np.arange(len(sizes)), sizes)[rows]
            f = fp[rows].view(np.uint64)
            for d in range(1, int(sizes[small].max())):
                pair = np.flatnonzero(group[d:] == group[:-d])
                if not len(pair):
                    break
                i, j = f[pair], f[pair + d]
                near = np.flatnonzero(_sliced_distance_within(i, j, radius))
                outs_a.append(i[near])
                outs_b.append(j[near])
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            f, o = fp[s : s + n], own[s : s + n]
            if left[s] == right[s]:
                i, j = within(f, f, radius)
                child, root = _forest(n, i[i < j], j[i < j])
                outs_a.append(f[child].view(np.uint64))
                outs_b.append(f[root].view(np.uint64))
            else:
                x, y = f[o == left[s]], f[o == right[s]]
                i, j = within(x, y, radius)
                both = np.concatenate([x, y])
                child, root = _forest(len(both), i, j + len(x))
                outs_a.append(both[child].view(np.uint64))
                outs_b.append(both[root].view(np.uint64))
        if outs_a and sum(map(len, outs_a)):
            a, b = np.concatenate(outs_a).view(np.int64), np.concatenate(outs_b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        key, left, right = cols[:3]
        last = np.flatnonzero((key != key[-1]) | (left != left[-1]) | (right != right[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from groups(*(c[:cut] for c in cols))
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield from groups(*rest)


def _sliced_distance_within(i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Whether each pair (i[k], j[k]) differs in at most ``radius`` bits, counted plane by plane, 64 pairs a word."""
    x = planes((i ^ j).view(np.int64))
    levels = max(1, radius.bit_length())
    counts = np.zeros((levels, x.shape[1]), dtype=np.uint64)
    over = np.zeros(x.shape[1], dtype=np.uint64)
    for p in range(64):
        carry = x[p].copy()
        for c in counts:
            c_new = c ^ carry
            carry &= c
            c[...] = c_new
        over |= carry
        if p % 16 == 15 and ((over | _exceeds(counts, radius)) == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            return np.zeros(len(i), dtype=bool)
    ok = ~(over | _exceeds(counts, radius))
    return np.unpackbits(ok.view(np.uint8), bitorder="little")[: len(i)].astype(bool)


def links_within(classes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links a, b between the distinct fingerprints in ``classes.fp``: enough of those within ``radius`` bits to
    connect all that they connect. A key's classes are cut into blocks of about ``block``."""
    keyed = classes.select("fp", F.explode(F.array(*_segment_keys(F.col("fp"), radius))).alias("key"))
    counts = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "keys")
    met = keyed.join(counts, "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A row goes to each pair of blocks that its own block is in.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("left"), F.greatest(F.col("own"), other).alias("right")))
    dealt = met.withColumn("own", own).withColumn("pair", F.explode(pairs)).select("key", "pair.left", "pair.right", "own", "fp")
    return dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInArrow(lambda it: _compare(it, radius), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Adds component_id: the smallest id that links of at most ``radius`` differing bits (column fp) reach."""
    prints = prints.drop("component_id")
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    component = connected_components(links_within(classes, radius))
    grouped = classes.join(component, classes["fp"] == component["node"], "left").select(classes["fp"].alias("_fp"), "first", F.coalesce("component", "fp").alias("_group"))
    grouped = materialise(grouped, "grouped")
    firsts = materialise(grouped.groupBy(F.col("_group").alias("_of")).agg(F.min("first").alias("component_id")), "firsts")
    of_class = materialise(grouped.join(firsts, F.col("_group") == F.col("_of")).select("_fp", "component_id"), "of_class")
    return prints.join(of_class, F.col("fp") == F.col("_fp")).drop("_fp")


def simhash_dedup(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id of every document."""
    return near_duplicates(materialise(fingerprints(docs, words, id_col, text_col), "prints"), radius, id_col)


# ------------------------------------------------------------------ near copies by verified similarity

#: Keys of a document, one for each random order of shingles: with a similarity of 0.8, all differ for one pair in
#: 390 thousand.
KEYS = 8
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
#: Bits in which the fingerprints of larger sets may differ before their shingles are compared. Of two large sets with a
#: similarity of 0.8 each bit differs with a probability of 0.152, and more than 28 of 64 for one pair in 100 million.
LOOSE = 28
#: Bitmaps of 32,768 rows (4 KB each) that are broadcast at most.
MOST_BITMAPS = 1 << 14
#: Sets of fewer shingles are compared by these whatever their fingerprints are: few shingles make noisy bits.
SMALL = 64


def sketch(text: str | None, words: int, seed: int = 42) -> tuple[int, list[int], np.ndarray]:
    """Fingerprint of a text's distinct shingles, its keys (smallest shingles under several orders), and the sorted
    distinct low halves of the shingles' hashes, by which similarities are verified."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    shingles = ([b" ".join(w)] if w else []) if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64))
    if not len(h):
        return 0, list(range(KEYS)), h.astype(np.uint32)
    keys = [int(((h * np.uint64(a)) ^ ((h * np.uint64(a)) >> np.uint64(29))).min()) for a in _ODD]
    return majority(h), keys, np.unique(h.astype(np.uint32))


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 250):
                part = b.slice(k, 250)
                made = [sketch(t, words) for t in part.column(2).to_pylist()]
                fp = np.array([m[0] for m in made], dtype=np.uint64).view(np.int64)
                keys = np.array([m[1] for m in made], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp), pa.array(list(keys), pa.list_(pa.int64())), pa.array([m[2].tobytes() for m in made], pa.binary())], ["row", "id", "fp", "keys", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select("_row", id_col, text_col).mapInArrow(run, f"row long, id {kind}, fp long, keys array<long>, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct arrays; of two empty ones it is 1."""
    if not len(a) and not len(b):
        return 1.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both / (len(a) + len(b) - both)


def _similarities(ids: np.ndarray, ends: np.ndarray, size: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Similarities of set x to others, of sets that lie one after another in ``ids`` and end at ``ends``."""
    mark = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
    mark[ids[ends[x] - size[x] : ends[x]]] = True
    shared = np.concatenate([[0], np.cumsum(mark[ids])])
    both = shared[ends[others]] - shared[ends[others] - size[others]]
    union = size[x] + size[others] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _verify(batches: Iterator[pa.RecordBatch], least: float, loose: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (number, key, left, right): a block of a key's rows, or two blocks of different numbers to
    compare with each other. Fingerprints are compared bit-sliced; pairs within the loose radius or of a small set that
    aren't connected yet are held to the similarity of their shingles. A pair counts under the first key it shares;
    but within one of several blocks of a key (``cut``) under all of them."""

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        number, left, right = (rows.column(c)[0].as_py() for c in ("number", "left", "right"))
        own, row, fp = (rows.column(c).to_numpy() for c in ("own", "row", "fp"))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        shingles = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
        a = np.flatnonzero(own == left)
        b = np.flatnonzero(own == right)
        size = np.array([len(x) for x in shingles])
        size_a, size_b = size[a][:, None], size[b][None, :]
        # A set similar to a small one isn't twice as large.
        meet = ((size_a < SMALL) & (size_b < SMALL * 2)) | ((size_a < SMALL * 2) & (size_b < SMALL))
        if not meet.all():
            meet[within(fp[a], fp[b], loose)] = True
        # Sets of too different sizes can't be similar; other pairs count under the first key they share.
        meet &= np.minimum(size_a, size_b) >= least * np.maximum(size_a, size_b)
        meet &= row[a][:, None] != row[b][None, :]
        if not rows.column("cut")[0].as_py():
            for k in range(number):
                meet &= keys[a, k][:, None] != keys[b, k][None, :]
        if left == right:
            meet = np.triu(meet, 1)
        group = np.arange(len(row))
        out_a, out_b = [], []
        ends = ids = None
        for k in np.flatnonzero(meet.any(axis=1)).tolist():
            x = int(a[k])
            others = b[meet[k] & (group[b] != group[x])]
            if many := len(others) > 16 and len(others) * 16 >= len(row):  # one pass over the block's shingles for all
                if ends is None:
                    ends, ids = np.cumsum(size), np.unique(np.concatenate(shingles), return_inverse=True)[1]
                others = others[_similarities(ids, ends, size, x, others) >= least]
            for y in others.tolist():
                if group[x] != group[y] and (many or similarity(shingles[x], shingles[y]) >= least):
                    low, high = sorted((int(group[x]), int(group[y])))
                    group[group == high] = low
                    out_a.append(row[x])
                    out_b.append(row[y])
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"]) if out_a else None

    rest: pa.Table | None = None
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = pa.Table.from_batches([batch.slice(k, 2048)])
            rows = part if rest is None else pa.concat_tables([rest, part])
            spot = np.stack([rows.column(c).to_numpy() for c in ("number", "key", "left", "right")])
            cuts = [0, *(np.flatnonzero((spot[:, 1:] != spot[:, :-1]).any(axis=0)) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s > 1 and (found := block(rows.slice(s, e - s))):
                    yield found
            rest = rows.slice(cuts[-1])
    if rest is not None and rest.num_rows > 1 and (found := block(rest)):
        yield found


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, loose: int = LOOSE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null ids come last, equal ids in
    the order of rows).

    Links join documents whose sets of ``words``-word shingles have a Jaccard similarity of at least ``least``;
    groups are what links connect. Equal sets are one class. Keys (a class's smallest shingle under each of several
    random orders) say which classes meet; all that meet are compared by bit-sliced fingerprints in blocks, and verified
    by their shingles, for which the low 32 bits of their hashes stand.

    Defined cases: null texts, empty ones and those of white space alone are copies of one another; fewer words than a
    shingle are one shingle; equal rows are copies; very long texts are compared whole; an empty table gives an empty
    result; all columns pass through, whatever their names.
    """
    with scope() as tables:
        rows, dropped = _copies(docs, words, least, loose, block, id_col, text_col)
    release(docs.sparkSession, tables, keep=(rows, dropped))
    return rows.join(dropped, F.col("_row") == F.col("_dropped"), "left_anti").select(*docs.columns)


def _meeting(sketches: DataFrame, places: DataFrame, most: int | None = None) -> DataFrame:
    """The sketches of rows that have a place, so that only their shingles move. Which rows these are is broadcast as
    bitmaps, a bit a document; were they more than ``most``, all sketches would move, with equal results."""
    bucket, bit = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    wanted = materialise(places.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "wanted")
    if wanted.count() > (MOST_BITMAPS if most is None else most):
        return sketches
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = sketches.join(F.broadcast(wanted), bucket == F.col("_bucket"))
    return marked.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*sketches.columns)


def _outside(met: DataFrame, component: DataFrame, block: int) -> DataFrame:
    """Places where the rows of a key outside its largest component meet all rows of the key. Blocks of these rows are
    numbered from 0, blocks of all rows from -1 downwards."""
    near = met.join(component.withColumnRenamed("node", "row"), "row", "left").withColumn("g", F.coalesce("component", "row"))
    sizes = materialise(near.groupBy("number", "key", "g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.groupBy("number", "key").agg(F.max(F.struct("n", "g"))["g"].alias("largest"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    near = materialise(near.join(largest, ["number", "key"]).withColumn("parts", F.ceil(F.col("rest") / block).cast("int")), "near")
    part = F.pmod(F.xxhash64("number", "row"), F.col("parts")).cast("int")
    columns = ["row", "number", "key", "own", "left", "right", F.lit(False).alias("cut")]
    all_rows = near.withColumns({"right": -1 - F.col("own"), "left": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).withColumn("own", F.col("right"))
    others = near.where("g <> largest").withColumns({"left": part, "right": F.explode(F.sequence(-F.col("blocks"), F.lit(-1)))}).withColumn("own", F.col("left"))
    return all_rows.select(*columns).unionByName(others.select(*columns))


def _copies(docs: DataFrame, words: int, least: float, loose: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their numbers (_row), and the numbers of those to drop (_dropped)."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # so that numbers stay
    made = materialise(_sketches(rows, words, id_col, text_col), "sketches")
    same = ["fp", F.xxhash64("shingles").alias("h")]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = materialise(made.groupBy(*same).agg(first, F.count(F.lit(1)).alias("n")), "classes")
    heads = made.select("row", "keys").join(classes.select(F.col("first.row").alias("row")), "row", "left_semi")
    keyed = materialise(heads.select("row", "keys", F.posexplode("keys").alias("number", "key")), "keyed")
    # A group all of whose rows also share an earlier key meets there already.
    same_key = [F.when(F.lit(k) < F.col("number"), F.min(F.col("keys")[k]) == F.max(F.col("keys")[k])).otherwise(False) for k in range(KEYS)]
    grouped = keyed.groupBy("number", "key").agg(F.count(F.lit(1)).alias("c"), *[f.alias(f"s{k}") for k, f in enumerate(same_key)])
    fresh = grouped.where("c > 1 AND NOT (" + " OR ".join(f"s{k}" for k in range(KEYS)) + ")")
    shared = materialise(fresh.select("number", "key", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "shared")
    own = F.pmod(F.xxhash64("row", "number"), F.col("blocks")).cast("int")
    met = materialise(keyed.drop("keys").join(shared, ["number", "key"]).withColumn("own", own), "met")
    spot, sketches = ["number", "key", "left", "right"], made.select("row", "fp", "keys", "shingles")

    def verified(places: DataFrame, name: str) -> DataFrame:
        """Links of rows that meet. What meets grows with the corpus, so it is never broadcast but as bits."""
        dealt = places.join(_meeting(sketches, places).hint("merge"), "row").repartition(*spot).sortWithinPartitions(*spot).select(*spot, "cut", "own", "row", "fp", "keys", "shingles")
        return materialise(dealt.mapInArrow(lambda it: _verify(it, least, loose), "a long, b long"), name)

    links = verified(met.select("row", "number", "key", "own", F.col("own").alias("left"), F.col("own").alias("right"), (F.col("blocks") > 1).alias("cut")), "verified")
    several = met.where("blocks > 1")
    if not several.isEmpty():
        links = links.unionByName(verified(_outside(several, connected_components(links), block), "verified"))
    component = connected_components(links)
    place = classes.select(F.col("first.row").alias("head"), "first").join(component, F.col("head") == F.col("node"), "left").withColumn("group", F.coalesce("component", "head"))
    kept = place.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    # Copies are fewer than documents, so it is they that are looked up.
    dropped = materialise(made.select("row").join(kept, "row", "left_anti").select(F.col("row").alias("_dropped")).sortWithinPartitions("_dropped"), "dropped")
    return rows, dropped
