"""Language-model scores: prediction by partial matching (PPM) over bytes, and a smoothed unigram base.

Texts are lower-cased (A-Z) and cut at ASCII white space; a text is coded as its words, each with a space after it,
and then the end, a symbol of its own. The model is a trie of byte contexts of up to ``ORDER`` bytes, which run over
the whole text from word to word: counts of what followed each context in the training texts. A symbol is coded from
the longest context seen; a context that lacks it escapes to the next shorter one, and symbols that the longer context
holds are excluded there. Escapes are estimated by method D: of a context whose symbols (those not excluded) were seen
n times and are k distinct ones, an escape has k / 2n and a symbol seen c times (2c - 1) / 2n. ``score`` is the sum
of the base-10 logarithms over all positions of a text.

Plan: one pass counts contexts and symbols of the training texts' positions, summed within a task before they are
shuffled. The trie goes to the executors as sorted arrays if it has at most ``trie_rows`` edges, checked before it
is gathered; a larger one is cut into parts by the last two symbols of a context, each built by one task and written
to the shared folder, and a task takes its texts, a group of chunks at a time, past all parts in turn, with equal
results: neither texts nor contexts are shuffled for it, and a worker holds one part. The pass that scores the texts also
numbers the words of each block of texts, and writes the texts as word numbers and the blocks' words with counts. Counts
are summed by word, go back to their blocks, and meet their texts there: one block a task.

Defined cases: a null text is an empty one, which is an end alone; a null id is the text of no digits for the
fold; without any training row the base is that of counts of zero, and symbols are equally likely; an empty
table gives an empty result; repeated rows are rows of their own and count each time; a very long text is one
chunk, whose positions one task holds; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm._store import filesystem, materialise, new_path, publish, release

#: Longest context in bytes, and symbols: the bytes and the end of a text.
ORDER, SYMBOLS = 5, 257
#: Symbols are written in 9 bits as 1 to 257, 0 being none: a context and a symbol fit 54 bits.
_BITS = 9
_END = 257
_BLOCK_BYTES = 24 << 20
#: Bytes of text whose positions are held at a time, and distinct contexts that a task sums before it passes them on.
_CHUNK_BYTES, _HELD_GRAMS = 2 << 20, 1_000_000
_TRIE_ROWS = 4_000_000
#: Bytes of text that meet all parts of a large trie at once, and edges of a part, about.
_GROUP_BYTES, _PART_ROWS = 16 << 20, 1_000_000


# ------------------------------------------------------------------ symbols


def positions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all symbols of the texts: context and symbol as one number (the longest context), and the text's place.
    The first word has a space before it."""
    pad = b"\x00" * (ORDER - 1) + b" "
    runs = [pad + b"".join([w + b" " for w in t.split()]) + b" " for t in texts]
    lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    flat = np.frombuffer(b"".join(runs), dtype=np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths)
    flat[ends - 1] = _END
    starts = (ends - lengths)[:, None] + np.arange(ORDER)
    flat[starts[:, :-1]] = 0
    full = flat.copy()
    for k in range(1, ORDER + 1):
        full[k:] |= flat[:-k] << _BITS * k
    coded = np.ones(len(flat), dtype=bool)
    coded[starts] = False
    return full[coded], np.repeat(np.arange(len(texts), dtype=np.int32), lengths - ORDER)


def shorter(full: np.ndarray, order: int) -> np.ndarray:
    """Context of at most ``order`` symbols, and symbol."""
    return full & ((1 << _BITS * (order + 1)) - 1)


def context_length(full: np.ndarray) -> np.ndarray:
    return sum((full >> _BITS * k > 0).astype(np.int64) for k in range(1, ORDER + 1))


# ------------------------------------------------------------------ the trie


class Trie:
    """Counts by (order, context, symbol) as sorted arrays; ``log10(full)`` for contexts and symbols."""

    def __init__(self, full: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None):
        """``full``: distinct longest contexts with symbols, ``counts``: how often each was seen in training. Of a part
        of a trie, ``low`` has the same of the whole trie's contexts of one symbol."""
        self.edges, self.edge_counts, self.nodes, self.totals, self.kinds, self.above = [], [], [], [], [], []
        for order in range(ORDER + 1):
            every, c = (full, counts) if low is None or order > 1 else low
            has = context_length(every) >= order
            edges, inverse = np.unique(shorter(every[has], order), return_inverse=True)
            c = np.bincount(inverse, c[has], len(edges))
            nodes, first = np.unique(edges >> _BITS, return_index=True)
            bounds = np.r_[first, len(edges)].astype(np.int64)
            self.edges.append(edges)
            self.edge_counts.append(c)
            self.nodes.append(nodes)
            self.totals.append(np.add.reduceat(c, bounds[:-1]) if len(nodes) else np.zeros(0))
            self.kinds.append(np.diff(bounds).astype(float))
            # What a context's symbols count for in the next shorter context: the mass that is excluded there.
            if order and len(edges):
                parent = np.searchsorted(self.edges[order - 1], shorter(edges, order - 1))
                self.above.append(np.add.reduceat(self.edge_counts[order - 1][parent], bounds[:-1]))
            else:
                self.above.append(np.zeros(len(nodes)))

    def log10(self, full: np.ndarray) -> np.ndarray:
        out = np.zeros(len(full))
        excluded, excluded_kinds = np.zeros(len(full)), np.zeros(len(full))
        todo = np.arange(len(full))
        length = context_length(full)
        for order in range(ORDER, -1, -1):
            nodes, edges = self.nodes[order], self.edges[order]
            own = todo[length[todo] >= order]
            if not len(own) or not len(nodes):
                continue
            key = shorter(full[own], order)
            node = np.searchsorted(nodes, key >> _BITS)
            node[node == len(nodes)] = 0
            seen = nodes[node] == key >> _BITS
            own, key, node = own[seen], key[seen], node[seen]
            mass, kinds = self.totals[order][node] - excluded[own], self.kinds[order][node] - excluded_kinds[own]
            edge = np.searchsorted(edges, key)
            edge[edge == len(edges)] = 0
            hit = edges[edge] == key
            open_ = kinds > 0
            whole = np.where(open_, 2 * mass, 1)
            out[own[hit]] += np.log10((2 * self.edge_counts[order][edge[hit]] - 1) / whole[hit])
            escape = ~hit & open_
            out[own[escape]] += np.log10(kinds[escape] / whole[escape])
            excluded[own], excluded_kinds[own] = self.above[order][node], self.kinds[order][node]
            done = np.zeros(len(full), dtype=bool)
            done[own[hit]] = True
            todo = todo[~done[todo]]
        rest = SYMBOLS - (self.kinds[0][0] if len(self.nodes[0]) else 0)
        out[todo] -= np.log10(rest)
        return out


def scores(trie: Trie, texts: list[bytes]) -> np.ndarray:
    full, place = positions(texts)
    distinct, inverse = _distinct(full)
    order = np.argsort(distinct)  # look-ups in order stay near one another
    logp = np.empty(len(distinct))
    logp[order] = trie.log10(distinct[order])
    return np.bincount(place, logp[inverse], len(texts))


def _distinct(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in the order in which they come, and each one's place there; hashed, not sorted."""
    coded = pa.array(full).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def part_of(full, parts: int):
    """The part of a trie in which a context is, by its last two symbols; of numbers or a column. All longer contexts
    that end alike are in the same part; shorter ones are in every part."""
    pair = (full.bitwiseAND(F.lit(((1 << 2 * _BITS) - 1) << _BITS)) if isinstance(full, Column) else full & (((1 << 2 * _BITS) - 1) << _BITS))
    mixed = pair * 0x9E3779B9
    return F.pmod(F.shiftright(mixed, 29), F.lit(parts)) if isinstance(full, Column) else (mixed >> 29) % parts


def scores_by_parts(parts: int, load, texts: list[list[bytes]]) -> list[np.ndarray]:
    """:func:`scores` of chunks of texts by a trie in parts, each loaded once: ``load(part)``."""
    places, inverses, own = [], [], []
    for chunk in texts:
        full, place = positions(chunk)
        distinct, inverse = _distinct(full)
        places.append(place)
        inverses.append(inverse)
        own.append(distinct)
    every, at = _distinct(np.concatenate(own))
    order = np.argsort(every)
    order = order[np.argsort(part_of(every[order], parts), kind="stable")]
    bounds = np.searchsorted(part_of(every[order], parts), np.arange(parts + 1))
    logp = np.empty(len(every))
    for part, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if first < last:
            logp[order[first:last]] = load(part).log10(every[order[first:last]])
    cuts = np.cumsum([0, *map(len, own)])
    return [np.bincount(place, logp[at[c : c + len(o)]][inverse], len(chunk)) for place, inverse, o, c, chunk in zip(places, inverses, own, cuts.tolist(), texts, strict=False)]


# ------------------------------------------------------------------ Spark


_PASS = T.StructType([T.StructField("block", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("score", T.DoubleType())])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a block's words (word, number, count in training texts), and its texts as word numbers.

    Numbers fall with frequency; those under 65,536 are written in two bytes, the others in four. Number 0 is the end.
    """
    from pyspark import TaskContext

    schema = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("number", pa.int32()), ("count", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("low", pa.binary()), ("high", pa.binary()), ("score", pa.float64())])
    block = TaskContext.get().partitionId() << 24

    def flush(number: dict[bytes, int], texts: list[np.ndarray], ids: list, held: list, whole: list) -> Iterator[pa.RecordBatch]:
        n = len(number)
        every = np.concatenate(texts)
        total = np.bincount(every, minlength=n)
        total[0] += len(every) + len(texts) + 1  # the end stays first
        rank = np.empty(n, dtype=np.int64)
        order = np.argsort(-total, kind="stable")
        rank[order] = np.arange(n)
        train = [t for t, h in zip(texts, held, strict=True) if not h]
        counts = np.bincount(np.concatenate(train), minlength=n) if train else np.zeros(n, np.int64)
        words = list(number)
        for k in range(0, n, 20_000):
            own = order[k : k + 20_000]
            m = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array([words[i] for i in own.tolist()], pa.binary()), pa.array(np.arange(k, k + m, dtype=np.int32)), pa.array(counts[own]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.float64())], schema=schema)
        for k in range(0, len(texts), 500):
            low, high = [], []
            for t in texts[k : k + 500]:
                r = rank[t]
                low.append(r[r < 65536].astype("<u2").tobytes())
                high.append(r[r >= 65536].astype("<u4").tobytes())
            m = len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(ids[k : k + 500], pa.int64()), pa.array(held[k : k + 500]), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.array(whole[k : k + 500], pa.float64())], schema=schema)

    number, texts, ids, held, whole, size = {b"": 0}, [], [], [], [], 0
    for b in batches:
        for key, text, out, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = (text or "").encode().lower()
            own = [number.setdefault(w, len(number)) for w in data.split()]
            own.append(0)
            texts.append(np.array(own, dtype=np.int32))
            ids.append(key)
            held.append(out)
            whole.append(score)
            size += len(data)
            if size >= _BLOCK_BYTES:
                yield from flush(number, texts, ids, held, whole)
                number, texts, ids, held, whole, size = {b"": 0}, [], [], [], [], 0
                block += 1
    if texts:
        yield from flush(number, texts, ids, held, whole)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of (doc_id, text, held_out) of at most ``_CHUNK_BYTES`` of text, or one text, with the texts' bytes."""
    for b in batches:
        sizes = [n or 0 for n in pc.binary_length(b.column(1)).to_pylist()]
        first, size = 0, 0
        for i, n in enumerate([*sizes, _CHUNK_BYTES]):
            if i > first and size + n > _CHUNK_BYTES or i == len(sizes) > first:
                part = b.slice(first, i - first)
                yield part, [(t or "").encode().lower() for t in part.column(1).to_pylist()]
                first, size = i, 0
            size += n


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of longest contexts with symbols over the positions of the training texts."""
    grams, counts = [], []

    def merge() -> None:
        every, inverse = _distinct(np.concatenate(grams))
        counts[:] = [np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64)]
        grams[:] = [every]

    def flush() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(grams[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[0][k : k + 200_000]), pa.array(counts[0][k : k + 200_000])], ["full", "c"])
        grams.clear()
        counts.clear()

    for part, texts in _chunks(batches):
        own = [t for t, out in zip(texts, part.column(2).to_pylist(), strict=True) if not out]
        if own:
            distinct, inverse = _distinct(positions(own)[0])
            grams.append(distinct)
            counts.append(np.bincount(inverse, minlength=len(distinct)))
        if sum(map(len, grams)) > _HELD_GRAMS:
            merge()
            if len(grams[0]) > _HELD_GRAMS // 2:
                yield from flush()
    if grams:
        merge()
        yield from flush()


_built: list = []


def _trie_of(arrays) -> Trie:
    """The trie of a broadcast, built once in a worker."""
    if not _built or _built[0] is not arrays:
        _built[:] = [arrays, Trie(*arrays.value)]
    return _built[1]


def _texts_by_arrays(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The blocks' rows of :func:`_number`, its texts with their scores."""
    got = edges.toArrow()
    arrays = docs.sparkSession.sparkContext.broadcast((got.column("full").to_numpy(), got.column("c").to_numpy().astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored() -> Iterator[pa.RecordBatch]:
            for b, texts in _chunks(batches):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(_trie_of(arrays), texts))], [*b.schema.names, "score"])

        return _number(scored())

    return docs.mapInArrow(run, _PASS)


def _texts_by_parts(docs: DataFrame, edges: DataFrame, parts: int, folder: str) -> DataFrame:
    """The same without gathering the trie: its parts are files of ``folder``, which each group of chunks reads in turn."""
    one = F.col("full").bitwiseAND(F.lit((1 << 2 * _BITS) - 1))
    got = edges.groupBy(one.alias("full")).agg(F.sum("c").alias("c")).toArrow()  # at most 257 x 257 rows
    low = (got.column("full").to_numpy(), got.column("c").to_numpy().astype(float))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("part", pa.int64()), ("full", pa.int64()), ("c", pa.int64())]))
        part, full, c = (rows.column(k).to_numpy() for k in rows.column_names)
        for k in np.unique(part).tolist():
            data = pickle.dumps(Trie(full[part == k], c[part == k].astype(float), low), protocol=5)
            publish(f"{folder}/{k}", lambda out, data=data: out.write(data))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["part"])

    cut = edges.select(part_of(F.col("full"), parts).alias("part"), "full", "c").repartition(parts, "part")
    built = {r.part for r in cut.mapInArrow(build, "part long").collect()}  # a number a part

    def load(part: int) -> Trie:
        if part not in built:  # no training text has such contexts
            return Trie(low[0][:0], low[1][:0], low)
        fs_, path = filesystem(f"{folder}/{part}")
        with fs_.open_input_stream(path, compression=None) as f:
            return pickle.loads(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(held: list[tuple[pa.RecordBatch, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            for (b, _), score in zip(held, scores_by_parts(parts, load, [texts for _, texts in held]) if held else [], strict=True):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

        def scored() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b, texts in _chunks(batches):
                own = sum(map(len, texts))
                if held and size + own > _GROUP_BYTES:
                    yield from group(held)
                    held, size = [], 0
                held.append((b, texts))
                size += own
            yield from group(held)

        return _number(scored())

    return docs.mapInArrow(run, _PASS)


def _deliver(key, texts: pa.Table, words: pa.Table) -> pa.Table:
    """Sums over a block's texts; its words come with their counts."""
    at = words.column("number").to_numpy()
    known, base = (np.empty(len(at)) for _ in range(2))
    known[at], base[at] = words.column("known").to_numpy(), words.column("base").to_numpy()
    n, k, b = (np.zeros(texts.num_rows) for _ in range(3))
    for i, (low, high) in enumerate(zip(texts.column("low").to_pylist(), texts.column("high").to_pylist(), strict=True)):
        ids = np.concatenate([np.frombuffer(low, "<u2"), np.frombuffer(high, "<u4")]).astype(np.int64)
        n[i], k[i], b[i] = len(ids), known[ids].sum(), base[ids].sum()
    return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n.astype(np.int64), "n_known": k.astype(np.int64), "base_score": b, "score": texts.column("score")})


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, trie_rows: int = _TRIE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Rows whose id's CRC-32 modulo ``folds`` is ``held`` are scored but never counted.
    """
    out = F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"))
    edges = materialise(docs.mapInArrow(_text_counts, "full long, c long").groupBy("full").agg(F.sum("c").alias("c")), "trie")
    if (n := edges.count()) <= trie_rows:
        numbered = materialise(_texts_by_arrays(docs, edges), "numbered")
    else:
        folder = new_path(docs.sparkSession, "trie-parts")
        numbered = materialise(_texts_by_parts(docs, edges, -(-n // _PART_ROWS), folder), "numbered")
        release(docs.sparkSession, [folder])
    in_blocks = numbered.where("word IS NOT NULL").select(F.col("block").alias("of_block"), "word", "number", "count")
    words = materialise(in_blocks.groupBy("word").agg(F.sum("count").alias("c")), "words")
    sizes = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = sizes["n"], sizes["v"]
    blocks = max(1, in_blocks.where("number = 0").count())  # every block has the end as its word 0
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    found = in_blocks.select("of_block", "word", "number").join(words, "word").select("of_block", "number", (F.col("c") > 0).cast("int").alias("known"), base.alias("base"))
    texts = numbered.where("low IS NOT NULL").select("block", "doc_id", "held_out", "low", "high", "score")
    met = texts.repartition(blocks, "block").groupBy("block").cogroup(found.repartition(blocks, "of_block").groupBy("of_block"))
    result = met.applyInArrow(_deliver, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
