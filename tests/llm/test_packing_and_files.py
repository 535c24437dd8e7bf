import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import packing, token_io
from spindrift.llm._tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["the cat sat", None, "", "naïve É words, it's 12³ 'S", "a\x1cb c", "<|endoftext|> hi <|", "İstanbul ΑΣ", "漢字 かな", "x" * 30_000, "the cat sat", "word " * 9000, " a\xa0b\x85c d"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunk_encoder_equals_library(library):
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(PATH).encode(TEXTS)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_every_code_point_of_the_plain_ranges(library):
    texts = [t for c in map(chr, range(0x2100)) for t in (f"a{c}b", f"{c} x{c}{c}'{c}s")]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(PATH).encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_the_cache_keeps_its_bound(library, monkeypatch):
    from spindrift.llm import _tokens

    monkeypatch.setattr(_tokens, "_CACHE_BYTES", 50_000)
    own = _tokens.ChunkEncoder(PATH)
    texts = [" ".join(f"word{k}x{k % 7}" for k in range(i, i + 300)) for i in range(0, 6000, 100)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.held <= 51_000 and len(own.cache) < 300


def test_digests_stand_for_ids(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, end_id=1, capacity=64, digests=True).collect()
    for r in rows:
        ids = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from spindrift.llm import _store

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        _store.shared_dir(session)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_rank_once_without_gaps(histogram):
    bins = {}
    for length, first, end, bin0, offset, uses in packing.plan(histogram, 64):
        for r in range(first, end):
            bins.setdefault(bin0 + (r - first) // uses, []).append((offset + (r - first) % uses * length, length, r))
    assert sorted((n, r) for b in bins.values() for _, n, r in b) == sorted((n, r) for n, c in histogram.items() for r in range(c))
    for b in bins.values():
        at = 0
        for offset, length, _ in sorted(b):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_finds_full_bins():
    rows = packing.plan({60: 5, 40: 5, 33: 9, 34: 1}, 100)
    assert max(r[3] + (r[2] - r[1]) // r[5] for r in rows) == 9  # 5 x (60+40), then 33, 33, 34 and two of three 33


def test_pack_documents(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id string")
    rows = packing.pack_documents(docs, PATH, end_id=1, capacity=4096).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.length == len(r.ids) // 4 <= 4096 and r.start == 4096 * r.piece
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert whole == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_pack_empty_and_bad_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, length long, offset int")
    assert packing.best_fit_pack(empty).collect() == []
    with pytest.raises(Exception, match="length must be from"):
        packing.best_fit_pack(spark.createDataFrame([(1, None)], "doc_id long, length long")).collect()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.floats(0, 1))
@settings(max_examples=40, deadline=None)
def test_shard_round_trip(ids, percentile):
    ids = np.array(ids, dtype="<u4")
    lengths = np.array([len(ids) // 3, len(ids) - len(ids) // 3])
    s = token_io.Shard(token_io.encode_shard([5, None], lengths, ids, percentile))
    assert s.ids().tolist() == ids.tolist() and s.null.tolist() == [0, 1] and s.starts.tolist() == [0, lengths[0]]
    a, b = len(ids) // 4, len(ids) // 2
    assert s.ids(a, b).tolist() == ids[a:b].tolist()


def test_damaged_shard_is_refused():
    data = bytearray(token_io.encode_shard([1], np.array([3]), np.array([1, 2, 70000])))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_io.Shard(bytes(data))


def test_keys_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        token_io.write_token_files(spark.createDataFrame([("a", "x")], "doc_id string, text string"), PATH, end_id=2)


def test_token_round_trip(spark, library):
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)
    rows = token_io.token_round_trip(docs, PATH, end_id=2, shard_ids=4000).collect()
    at = 0
    for i in [4, *(k for k in range(len(TEXTS)) if k != 4)]:
        ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        (r,) = [r for r in rows if r.doc_id == (None if i == 4 else i)]
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_io.token_round_trip(docs.limit(0), PATH, end_id=2).collect() == []
