import hashlib

import pytest

from docforge.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", None, " ", "a", "Hello world's best\n\n  indent\t", "Éêü ñ 漢字 🙂🙂 é", "x" * 5000, " " * 3000 + "y", "\r\n" * 400, "1234567890" * 50,
    "<|endoftext|> <unk> ▁ ▁▁", "\x00\x01\x7f\x80", "don't DON'T 'll", "  　", "ünïcödé " * 2000,
]


@pytest.fixture(scope="module")
def own():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_are_those_of_tiktoken_and_decode_back(spark, own):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, None, "x")], "doc_id long, text string, ids string")
    ids = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    assert ids == {(i, tuple(own.encode_ordinary(t or ""))) for i, t in enumerate(TEXTS)}
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.content) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in bpe.round_trip(docs, PATH, P.PATTERN).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(own.encode_ordinary(text))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own.encode_ordinary(text))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_all_documents_as_tiktoken(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(text)
    assert all(list(r.ids) == own.encode_ordinary(text[r.doc_id]) for r in got)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="lacks"):
        bpe.Codec({b"a": 0}, P.PATTERN)
