"""Best-fit packing by minimum bin slack.

Pieces are packed by their lengths alone, so the work on the driver is over the histogram of lengths, at
most ``capacity`` rows whatever the corpus holds. Each step takes the longest length left, finds by a bitset
subset-sum over the lengths still available the fullest bin that holds it, and removes that combination as
often as the counts allow: thousands of equal bins cost one step. A plan is a list of intervals of ranks
within a length; executors turn each piece's rank into its bin and offset.

Texts are encoded, cut and ranked in one pass of one Python worker a core (:func:`pack_documents`); what is written
from it holds no ids unless they are asked for.

Defined cases: a null text is an empty one; a very long one is one row of ids while it is cut; an empty table gives an empty result; repeated rows and equal
ids are packed as rows of their own; a length of null, under 1 or over the capacity is an error, as nothing
holds it; columns named like the new ones are replaced by them; all other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindrift.llm._store import materialise


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """How often to use each length so that their sum is the largest that ``room`` holds.

    Bit s of ``reach`` says that the sum s is reachable. Multiplicities go in as powers of two; each step
    keeps the bitset before it, from which the combination is read backwards.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in order:
        left, k = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(k, left)
            wider = reach | (reach << length * take) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    uses: dict[int, int] = {}
    total = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            uses[length] = uses.get(length, 0) + take
            total -= length * take
    return uses


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, offset of the first use, uses a bin).

    The rank r of a length within [first, end) goes to bin ``first bin + (r - first) // uses``, at
    ``offset + (r - first) % uses * length``.
    """
    left = {k: n for k, n in histogram.items() if n}
    order = sorted(left, reverse=True)
    at = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while order:
        longest = order[0]
        left[longest] -= 1
        uses = fullest(left, [x for x in order if left[x] and x <= capacity - longest], capacity - longest)
        left[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(left[x] // n for x, n in uses.items())
        offset = 0
        for x, n in sorted(uses.items(), reverse=True):
            rows.append((x, at[x], at[x] + n * times, bins, offset, n))
            at[x] += n * times
            left[x] -= n * times
            offset += n * x
        bins += times
        order = [x for x in order if left[x]]
    return rows


def _ranked(batches: Iterator[pa.RecordBatch], length_col: str) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's rank among the task's rows of its length."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        lengths = np.asarray(b.column(b.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False), dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        values, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
        rank = np.empty(len(lengths), dtype=np.int64)
        base = np.array([seen.get(int(v), 0) for v in values], dtype=np.int64)
        rank[order] = np.arange(len(lengths)) - np.repeat(first - base, count)
        for v, n in zip(values.tolist(), count.tolist(), strict=True):
            seen[v] = seen.get(v, 0) + n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part, dtype=np.int32)), pa.array(rank)], [*b.schema.names, "_part", "_rank"])


def best_fit_pack(pieces: DataFrame, length_col: str = "length", capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset (long) to ``pieces``: no bin exceeds ``capacity``, offsets are gapless from 0."""
    pieces = pieces.drop("sequence_id", "offset", "_part", "_rank")
    length = F.col(length_col)
    checked = pieces.withColumn(length_col, F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.lit(f"{length_col} must be from 1 to {capacity}"))).cast("long"))
    ranked = materialise(checked.mapInArrow(lambda it: _ranked(it, length_col), _with_rank(checked.schema)), "pieces")
    return _placed(ranked, length_col, capacity)


def _with_rank(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])


def _placed(ranked: DataFrame, length_col: str, capacity: int) -> DataFrame:
    """Bins and offsets of written rows with ``_part`` and ``_rank``."""
    names, length = [c for c in ranked.columns if c not in ("_part", "_rank")], F.col(length_col)
    by_part = ranked.groupBy(length, "_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = by_part.select(length.alias("_length"), F.col("_part").alias("_of"), (F.sum("_n").over(Window.partitionBy(length).orderBy("_part")) - F.col("_n")).alias("_base"))
    histogram = {r[0]: r[1] for r in ranked.groupBy(length).count().collect()}  # at most ``capacity`` rows
    rows = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 6)

    # A row of the plan is found by its length and first rank together.
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = int(rows[:, 2].max()) + 1 if len(rows) else 1
        keys = rows[:, 0] * spread + rows[:, 1]
        for b in batches:
            lengths, rank = (np.asarray(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False), dtype=np.int64) for c in (length_col, "_global"))
            k = np.searchsorted(keys, lengths * spread + rank, side="right") - 1
            inside = rank - rows[k, 1]
            bins, offset = rows[k, 3] + inside // rows[k, 5], rows[k, 4] + inside % rows[k, 5] * lengths
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bins), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = ranked.join(bases, (ranked[length_col] == bases["_length"]) & (ranked["_part"] == bases["_of"])).withColumn("_global", F.col("_rank") + F.col("_base"))
    out = T.StructType([*(ranked.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.select(*names, "_global").mapInArrow(place, out)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, capacity: int, digests: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of (id, text); their ids, or only the unsigned CRC-32 of these."""
    from spindrift.llm._tokens import encoder

    encode, end, step = encoder(tokenizer_path), np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            row, piece, start, length, last = [], [], [], [], []
            for i, packed in enumerate(encode.encode(part.column(1).to_pylist())):
                whole = packed + end
                for j, at in enumerate(range(0, len(whole), step)):
                    ids = whole[at : at + step]
                    row.append(i)
                    piece.append(j)
                    start.append(j * capacity)
                    length.append(len(ids) // 4)
                    last.append(zlib.crc32(ids) if digests else ids)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(last, pa.int64() if digests else pa.binary())],
                [b.schema.names[0], "piece", "start", "length", "ids_crc32" if digests else "ids"],
            )


def _piece_schema(docs: DataFrame, id_col: str, digests: bool) -> T.StructType:
    last = T.StructField("ids_crc32", T.LongType()) if digests else T.StructField("ids", T.BinaryType())
    return T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), last])


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids, ``end_id`` appended, cut into pieces of at most ``capacity``.

    Columns: the id, piece (int, from 0), start and length (long), ids (binary, little-endian unsigned 32-bit).
    """
    return docs.select(id_col, text_col).mapInArrow(lambda it: _cut(it, tokenizer_path, end_id, capacity, False), _piece_schema(docs, id_col, False))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Pieces of every document with their places: the columns of :func:`token_pieces`, sequence_id and offset.

    With ``digests``, the unsigned CRC-32 of each piece's ids (ids_crc32, long) stands for the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ranked(_cut(batches, tokenizer_path, end_id, capacity, digests), "length")

    ranked = docs.select(id_col, text_col).mapInArrow(run, _with_rank(_piece_schema(docs, id_col, digests)))
    return _placed(materialise(ranked, "pieces"), "length", capacity)
