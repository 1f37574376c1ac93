import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from keystrata.llm.bpe import Encoder, count_tokens, decode_documents, default_vocabulary, encode_documents, read_ranks

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return read_ranks(default_vocabulary())


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return Encoder(vocabulary)


def merged(ranks, piece):
    """Merges applied one by one, the lowest rank first."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(piece=st.one_of(st.binary(max_size=24), st.text(alphabet="abeinrst' ", max_size=30).map(str.encode), st.text(max_size=12).map(str.encode)))
def test_pieces_equal_merging_one_by_one(encoder, piece):
    assert encoder.encode_bytes(piece) == merged(encoder.ids, piece)


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sé漢1２　🔥")), max_size=80))
def test_texts_equal_a_public_encoder_and_round_trip(encoder, vocabulary, text):
    public = _public(vocabulary)
    ids = encoder.encode(text)
    assert ids == public.encode_ordinary(text)
    assert encoder.decode(np.array(ids)).decode() == text


_kept = {}


def _public(vocabulary):
    if not _kept:
        import public_tokenizers

        _kept["e"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    return _kept["e"]


def test_documents_with_nulls_empty_long_and_special_texts(spark, vocabulary):
    texts = [None, "", " ", "a" * 30000, "x\r\n\n  y  \n", "<|endoftext|>", "naïve 漢字\n\n  code(1)\n", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as ids", "'k' as key")
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    public = _public(vocabulary)
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    back = decode_documents(encode_documents(df))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_documents(df).collect() == []


def test_memory_of_a_worker_is_bounded(spark, monkeypatch):
    from keystrata.llm import bpe

    tokens = bpe.read_ranks(bpe.default_vocabulary())
    encoder = bpe.Encoder(tokens)
    text = "".join(chr(97 + i * i % 26) + " x" * (i % 3) for i in range(4000))
    want = encoder.encode(text)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 50)
    other = bpe.Encoder(tokens)
    assert other.encode(text) == want and len(other._pairs) <= 50
    batch = bpe.pa.RecordBatch.from_arrays([bpe.pa.array([1, 2, 3, 4]), bpe.pa.array(["a" * 40, None, "b", "c" * 40])], ["k", "t"])
    monkeypatch.setattr(bpe, "OUT_BYTES", 30)
    parts = [(k.to_pylist(), r) for k, r in bpe._in_parts(batch, lambda t: (t, len(t or "")))]
    assert parts == [([1], ["a" * 40]), ([2, 3, 4], [None, "b", "c" * 40]), ([], [])]


def test_a_large_vocabulary_is_sent_as_a_file(spark, monkeypatch):
    from keystrata.llm import bpe

    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    want = sorted(map(tuple, bpe.encode_documents(df).collect()), key=str)
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    bpe._made.clear()
    assert sorted(map(tuple, bpe.encode_documents(df).collect()), key=str) == want
