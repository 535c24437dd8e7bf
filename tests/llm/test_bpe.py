import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "  ", "Hello there, it's  'S 12²³ ½a\n\n\n x", "aaaaaaaaa aaa", "x" * 5000, "<|endoftext|> hi<|endoftext|>", "a\x1cb \x1c c", "naïvé é à", "漢字 かな ☃", "a\xa0b\x85c \xa0 d", "word " * 5000, "Hello there", "Hello there"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=80, deadline=None)
def test_equals_library(texts):
    own, library = bpe.model(PATH), Tokenizer.from_file(PATH)
    texts = [t for t in texts if all(ord(c) < 0x3000 for c in t)]  # letters that all Unicode versions know
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids.tolist()) == text


@given(st.lists(st.integers(0, 60_000), max_size=20))
@settings(max_examples=80, deadline=None)
def test_decode_equals_library(ids):
    assert bpe.model(PATH).decode(ids) == Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)


def test_on_a_table(spark, library):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    rows = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].decoded == (t or "") and rows[i].text == t
    assert bpe.bpe_encode(df.limit(0), PATH).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.bpe_decode(nulls, PATH).collect()[0].decoded == ""
