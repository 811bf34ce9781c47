"""Byte-level BPE encoding and decoding with a sentencepiece model written directly from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release

#: Pre-tokens whose ids a worker remembers; the table starts anew beyond that.
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it has a visible form in Latin-1, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()
AS_LETTERS = {b: LETTERS[b] for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece i has the token of the i-th rank in byte letters, scored by the negative rank.

    The unknown piece comes last, as the pieces' numbers are to follow the ranks; with all 256 bytes in the vocabulary it never occurs.
    """
    pieces = [_field(1, _field(1, "".join(map(AS_LETTERS.__getitem__, token)).encode()) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    plain = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, plain)


class Codec:
    """Encodes as the tiktoken library would with the same ranks and pattern and no special tokens; decodes ids to bytes.

    Each match of the pattern that is itself in the vocabulary is that token; others are merged by the model.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.by_number = sorted(ranks.values())
        self.dense = self.by_number == list(range(len(ranks)))
        self.whole = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(ranks))
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, parts: set[str]) -> None:
        """The ids of pre-tokens that aren't remembered, by one call for all of them."""
        merged = []
        for part in parts:
            if (rank := self.whole.get(part.encode())) is not None:
                self.known[part] = (rank,)
            else:
                merged.append(part)
        if merged:
            letters = ["".join(map(AS_LETTERS.__getitem__, part.encode())) for part in merged]
            numbers = self.pieces.encode(letters, out_type=int, num_threads=1)
            if not self.dense:
                numbers = [map(self.by_number.__getitem__, x) for x in numbers]
            self.known.update(zip(merged, map(tuple, numbers)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; pre-tokens that are new to all of them are merged in one call."""
        parts = list(map(self.split, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := set().union(*parts).difference(self.known):
            self.learn(new)
        for own in parts:
            yield list(itertools.chain.from_iterable(map(self.known.__getitem__, own)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODEC: dict[str, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    ranks, model, key = shared.value
    key += pattern
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(ranks, pattern, model)
    return _CODEC[key]


def vocabulary(spark: SparkSession, path: str):
    """The ranks and the model, sent to the executors once. Bounded by the vocabulary file, which doesn't grow with the data."""
    ranks = read_ranks(path)
    model = model_bytes(ranks)
    return spark.sparkContext.broadcast((ranks, model, hashlib.sha256(model).hexdigest()))


def groups(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in groups of about so many characters; nulls as empty texts."""
    group, size = [], 0
    for text in texts:
        group.append(text := text.as_py() or "")
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    yield group


def _mapped(df: DataFrame, vocab, pattern: str, columns: list[str], schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(codec, part.column(1))], names=["doc_id", *columns])
        release(codec.known)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each row's whole text; a null or empty text has no ids. No rows come from an empty table."""
    kind = dict(docs.dtypes)[id_col]

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        return [pa.array([ids for group in groups(texts) for ids in codec.encode_all(group)], pa.list_(pa.int32()))]

    return _mapped(docs.select(F.col(id_col).alias("doc_id"), text_col), vocabulary(docs.sparkSession, path), pattern, ["ids"], f"doc_id {kind}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, content binary: the bytes that the ids stand for; null ids have no bytes. An id outside the vocabulary is an error."""
    kind = dict(encoded.dtypes)[id_col]

    def make(codec: Codec, ids: pa.Array) -> list[pa.Array]:
        return [pa.array([codec.decode(x.as_py() or []) for x in ids], pa.binary())]

    return _mapped(encoded.select(F.col(id_col).alias("doc_id"), ids_col), vocabulary(encoded.sparkSession, path), pattern, ["content"], f"doc_id {kind}, content binary", make)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes decoded from these ids); with_ids: ids, too.

    encode and decode in one pass, so that the ids of a corpus need not leave the workers. Nulls count as empty texts;
    rows that repeat give a row each; columns of other names are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def make(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        rows, kept = [], []
        for ids in (ids for group in groups(texts) for ids in codec.encode_all(group)):
            rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        n, ids, decoded = zip(*rows)
        out = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        if with_ids:
            ends = pa.array([0, *itertools.accumulate(map(len, kept))], pa.int32())
            out.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(kept)))
        return out

    names, schema = ["n_tokens", "ids_sha256", "decoded_sha256"], f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs.select(F.col(id_col).alias("doc_id"), text_col), vocabulary(docs.sparkSession, path), pattern, names + ["ids"] * with_ids, schema + ", ids array<int>" * with_ids, make)
