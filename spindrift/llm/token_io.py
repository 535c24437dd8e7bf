"""Token ids in binary files of patched frame-of-reference blocks.

A shard holds the ids of many documents one after another, in blocks of ``BLOCK`` ids. A block stores its
minimum and the differences from it, packed at the width that a percentile of them needs; the larger ones
(the patches) keep their low bits in place, and a list holds their positions and high bits. Every block's
start is in the index, so any id is read without the blocks before it.

Layout, little-endian: magic ``PFOR``, u32 version, u64 documents, u64 ids, u64 blocks; i64 document keys,
u8 whether a key is null, u64 starts of documents; u64 starts of blocks; the blocks; u32 CRC-32 of all before.
A block: u32 minimum, u8 width, u8 zero, u16 patches; packed lanes; u16 patch positions; u32 patch high bits.
Packing is by lanes: of the 1024 ids, lane k (of 16) holds every 16th; its 64 values of w bits fill w words.

Files are named by shard, in ascending order of the key; each is written whole and moved into place, so a
task that runs again replaces it by an equal one. Writing needs a store that pyarrow opens; reading goes
through Spark's binaryFile source.

Defined cases: a null text is an empty one (only the end id); null keys come first; rows with equal keys are
ordered by a hash of their texts; keys that aren't whole numbers are an error; a very long text stands whole in
one shard; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindrift.llm._store import new_path, publish, materialise

BLOCK = 1024
_LANES, _PER_LANE = 16, 64
_HEAD = struct.Struct("<4sIQQQ")


def pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values under 2**width -> (blocks, width * lanes) words of 64 bits."""
    n = len(values)
    words = np.zeros((n, width, _LANES), dtype="<u8")
    lanes = values.reshape(n, _PER_LANE, _LANES).astype(np.uint64)
    for j in range(_PER_LANE if width else 0):
        word, shift = divmod(j * width, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.reshape(n, -1)


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    words = words.reshape(n, width, _LANES)
    out = np.zeros((n, _PER_LANE, _LANES), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(_PER_LANE if width else 0):
        word, shift = divmod(j * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(n, -1)


def encode_shard(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.95) -> bytes:
    """One shard file. ``ids``: those of all documents; ``lengths``: ids of each."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.empty((blocks, BLOCK), dtype=np.int64)
    flat = padded.reshape(-1)
    flat[:n] = ids
    if n % BLOCK:
        flat[n:] = flat[n - 1]
    low = padded.min(axis=1) if blocks else np.zeros(0, np.int64)
    diff = padded - low[:, None]
    k = min(BLOCK - 1, int(percentile * BLOCK))
    common = np.partition(diff, k, axis=1)[:, k] if blocks else np.zeros(0, np.int64)
    widths = np.zeros(blocks, dtype=np.int64)
    for w in range(32):
        widths[common >> w > 0] = w + 1
    body: list[bytes] = [b""] * blocks
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        packed = pack_lanes(diff[at] & ((1 << w) - 1), w)
        high = diff[at] >> w
        rows, pos = np.nonzero(high)
        ends = np.searchsorted(rows, np.arange(len(at) + 1))
        pos, patch = pos.astype("<u2"), high[high > 0].astype("<u4")
        for i, b in enumerate(at.tolist()):
            s, e = ends[i], ends[i + 1]
            body[b] = struct.pack("<IBBH", int(low[b]), w, 0, e - s) + packed[i].tobytes() + pos[s:e].tobytes() + patch[s:e].tobytes()
    starts = np.zeros(len(keys), dtype="<u8")
    starts[1:] = np.cumsum(lengths)[:-1]
    index = np.zeros(blocks, dtype="<u8")
    index[1:] = np.cumsum([len(x) for x in body])[:-1]
    null = np.array([x is None for x in keys], dtype=np.uint8)
    head = _HEAD.pack(b"PFOR", 1, len(keys), n, blocks)
    out = b"".join([head, np.array([0 if x is None else x for x in keys], dtype="<i8").tobytes(), null.tobytes(), starts.tobytes(), index.tobytes(), *body])
    return out + struct.pack("<I", zlib.crc32(out))


class Shard:
    """A shard file's content; ``ids(a, b)`` reads only the blocks that hold those ids."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a token shard is damaged")
        magic, version, self.n_docs, self.n_ids, self.n_blocks = _HEAD.unpack_from(data)
        if (magic, version) != (b"PFOR", 1):
            raise ValueError("not a token shard of version 1")
        at = _HEAD.size
        self.keys = np.frombuffer(data, "<i8", self.n_docs, at)
        self.null = np.frombuffer(data, np.uint8, self.n_docs, at := at + 8 * self.n_docs)
        self.starts = np.frombuffer(data, "<u8", self.n_docs, at := at + self.n_docs)
        self.index = np.frombuffer(data, "<u8", self.n_blocks, at := at + 8 * self.n_docs)
        self.blocks_at, self.data = at + 8 * self.n_blocks, data

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        if end <= first:
            return np.zeros(0, dtype="<u4")
        b0, b1 = first // BLOCK, -(-end // BLOCK)
        out = np.empty((b1 - b0, BLOCK), dtype=np.uint64)
        heads = [struct.unpack_from("<IBBH", self.data, self.blocks_at + int(self.index[b])) for b in range(b0, b1)]
        widths = np.array([h[1] for h in heads])
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            words = np.array([np.frombuffer(self.data, "<u8", w * _LANES, self.blocks_at + int(self.index[b0 + r]) + 8) for r in rows.tolist()], dtype=np.uint64).reshape(len(rows), -1)
            out[rows] = unpack_lanes(words, w)
        for r, (low, w, _, n) in enumerate(heads):
            if n:
                at = self.blocks_at + int(self.index[b0 + r]) + 8 + 8 * w * _LANES
                pos = np.frombuffer(self.data, "<u2", n, at)
                out[r, pos] |= np.frombuffer(self.data, "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(w)
            out[r] += np.uint64(low)
        return out.reshape(-1)[first - b0 * BLOCK : end - b0 * BLOCK].astype("<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, shard_ids: int = 1 << 23, percentile: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the shards in ascending order of the key.

    Returns the manifest, one row per shard: part, shard (int), path, n_docs, n_ids (long), first_id (long:
    ids in all shards before it). The texts are dealt out by key range once; ids never shuffle.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number: files hold keys of 64 bits")
    spark = docs.sparkSession
    folder = path or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from spindrift.llm._tokens import encoder

        encode, end, part = encoder(tokenizer_path), np.uint32(end_id).astype("<u4").tobytes(), TaskContext.get().partitionId()
        keys, packed, held, shard = [], [], 0, 0

        def flush():
            nonlocal keys, packed, held, shard
            name = f"{folder}/part-{part:06d}-{shard:06d}.pfor"
            data = encode_shard(keys, np.array([len(x) // 4 for x in packed], dtype=np.int64), np.frombuffer(b"".join(packed), "<u4"), percentile)
            publish(name, lambda out: out.write(data))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": name, "n_docs": len(keys), "n_ids": held}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            keys, packed, held, shard = [], [], 0, shard + 1
            return row

        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                for key, x in zip(s.column(0).to_pylist(), encode.encode(s.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    packed.append(x + end)
                    held += len(x) // 4 + 1
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    order = ["key", F.xxhash64("text")]
    manifest = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "part int, shard int, path string, n_docs long, n_ids long"), "manifest")
    # Two steps, so that no task holds all shards' rows: sums by part, then within each part.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return manifest.withColumn("within", within).join(parts, F.col("part") == F.col("of")).withColumn("first_id", F.col("within") + F.col("before")).select("part", "shard", "path", "n_docs", "n_ids", "first_id")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards in ``folder``: part, shard, doc_id, start (within its shard), n_tokens,
    ids (binary, little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for i in range(b.num_rows):
                part, number = (int(x) for x in b.column(0)[i].as_py().rpartition("/")[2].removesuffix(".pfor").split("-")[1:])
                s = Shard(b.column(1)[i].as_py())
                ids, ends = s.ids(), np.append(s.starts[1:], s.n_ids).astype(np.int64)
                starts = s.starts.astype(np.int64)
                for k in range(0, s.n_docs, 2000):
                    a, z = starts[k : k + 2000], ends[k : k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(a), part, np.int32)), pa.array(np.full(len(a), number, np.int32)), pa.array(s.keys[k : k + 2000], mask=s.null[k : k + 2000] > 0),
                            pa.array(a), pa.array(z - a), pa.array([ids[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist(), strict=True)], pa.binary()),
                        ],
                        schema=schema,
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    return files.mapInArrow(read, "part int, shard int, doc_id long, start long, n_tokens long, ids binary")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Write the files, read them back, and place each document among all ids: doc_id, start, n_tokens, ids."""
    spark = docs.sparkSession
    folder = options.pop("path", None) or new_path(spark, "tokens")
    manifest = write_token_files(docs, tokenizer_path, end_id, path=folder, **options).select("part", "shard", "first_id")
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    docs_of = read_token_files(spark, folder)
    return docs_of.join(manifest, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("first_id")).alias("start"), "n_tokens", "ids")
