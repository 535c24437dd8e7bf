"""Byte-level BPE by a pair occurrence index.

The distinct words of a batch lie one after another in one array of symbols, linked to their neighbours.
An index maps each rank (a pair that merges) to all positions where the pair stands. Active ranks are applied
in ascending order: all occurrences of the pair merge at once, and the pairs that arise left and right of
them enter the lists of their own ranks. A merge only makes pairs of later ranks, so one ascending pass over
the batch gives each word what merging it alone, lowest rank first, would give.

Ids equal those of the tokenizers library with the same file, truncation and padding unused and no special
tokens added; strings of added tokens that stand in a text become those tokens, as they do there. Decoding
joins the bytes of the ids and reads them as UTF-8, with U+FFFD for what isn't.

Defined cases: a null text is an empty one, which has no ids and decodes to the empty text; a null list of ids
decodes to the empty text; an id that the vocabulary lacks is skipped, as the library does; columns named like
the new ones are replaced by them; all other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spindrift.llm._tokens import byte_letters

_PLAIN = re.compile("[\t-\r -~\x85\xa0-ɏ‐-‧‰-⁞€]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: The split pattern of byte-level vocabularies, for the plain range and in general.
_PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_CACHE_WORDS, _BATCH_BYTES = 500_000, 12 << 20


class PairIndexBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[x] for x in letters], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.left, self.right = keys // self.size, keys % self.size
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.split_any = regex.compile(_SPLIT)
        byte_of = {x: b for b, x in enumerate(letters)}
        self.bytes_of = [b""] * (max([self.size, *(i + 1 for i in self.added.values())]))
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in word) if all(c in byte_of for c in word) else word.encode()
        for word, i in self.added.items():
            self.bytes_of[i] = word.encode()
        self.cache: dict[str, np.ndarray] = {}

    def words(self, text: str) -> list[str]:
        return (_PLAIN_SPLIT if _PLAIN.fullmatch(text) else self.split_any).findall(text)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges (or a word ends between)."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. The index, its lists and the links live for this one pass."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in raw), dtype=np.int64, count=len(raw)))
        flat = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        sym = self.of_byte[flat]
        sym[ends - 1] = -1  # a wall after each word
        after = np.arange(1, len(sym) + 1)
        after[-1] = len(sym) - 1
        before = np.arange(-1, len(sym) - 1)
        before[0] = len(sym) - 1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self._rank_of(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, a, b in zip(rank[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(sym >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = self.left[r], self.right[r]
            at = at[(sym[at] == left) & (sym[after[at]] == right)]  # others have merged meanwhile
            if not len(at):
                continue
            if left == right and len(at) > 1:  # in a run of the same symbol, every other pair
                at = np.unique(at)
                starts = np.r_[True, after[at[:-1]] != at[1:]]
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            sym[gone] = -2
            after[at] = beyond
            before[beyond] = at
            enter(np.concatenate([at, before[at]]))
        live = sym != -2
        ids = sym[live]
        walls = np.flatnonzero(ids == -1)
        ids32 = ids.astype(np.int32)
        return [ids32[a:b] for a, b in zip([0, *(walls[:-1] + 1).tolist()], walls.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Words become numbers as they are read, so that only distinct ones are held."""
        number: dict[str | int, int] = {}
        parts: list[np.ndarray] = []
        for text in texts:
            text = text or ""
            own, at = [], 0
            for m in self.cut_added.finditer(text) if self.added and "<" in text else ():
                own += [*self.words(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            own += self.words(text[at:])
            parts.append(np.array([number.setdefault(w, len(number)) for w in own], dtype=np.int32))
        new = [w for w in number if w not in self.cache]
        if len(self.cache) + len(new) > _CACHE_WORDS:
            self.cache = {}
            new = list(number)
        plain = [w for w in new if isinstance(w, str)]
        self.cache.update((w, x.tobytes()) for w, x in zip(plain, self.merge(plain), strict=True))
        self.cache.update((w, np.int32(w).tobytes()) for w in new if not isinstance(w, str))
        ids = [self.cache[w] for w in number]
        del number
        return [np.frombuffer(b"".join([ids[k] for k in p.tolist()]), dtype=np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        known, n = self.bytes_of, len(self.bytes_of)
        try:
            return b"".join([known[i] for i in ids]).decode("utf-8", "replace")
        except IndexError:
            return b"".join([known[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")


_models: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    if path not in _models:
        _models[path] = PairIndexBpe(path)
    return _models[path]


def _replace(b: pa.RecordBatch, keep: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), column], [*keep, name])


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids_col`` (array<int>): the ids of the whole text. ``keep``: the columns that stay (default: all)."""
    keep = [c for c in (df.columns if keep is None else keep) if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = iter(bpe.encode([t for b in held for t in b.column(b.schema.get_field_index("_text")).to_pylist()]))
            for b in held:
                own = [next(ids) for _ in range(b.num_rows)]
                for k in range(0, b.num_rows, 250):
                    part = own[k : k + 250]
                    offsets = np.zeros(len(part) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in part], out=offsets[1:])
                    yield _replace(b.slice(k, 250), keep, ids_col, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part) if part else np.zeros(0, np.int32))))

        held, size = [], 0
        for b in batches:
            for k in range(0, b.num_rows, 250):
                part = b.slice(k, 250)
                held.append(part)
                size += part.column(part.schema.get_field_index("_text")).nbytes
                if size > _BATCH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return df.select(*keep, df[text_col].alias("_text")).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text of the ids, special tokens included."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            for k in range(0, b.num_rows, 250):
                part = b.slice(k, 250)
                ids = part.column(part.schema.get_field_index(ids_col))
                yield _replace(part, keep, text_col, pa.array([bpe.decode([] if x.as_py() is None else x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids], pa.string()))

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(text_col, T.StringType())]))
