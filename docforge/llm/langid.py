"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of n-grams, and the lengths of n-grams that are counted.
BITS, LENGTHS = 14, (1, 2, 3)
#: Characters that are turned into n-grams at once.
PIECE = 1 << 18
#: Languages that one pass over a partition counts at a time.
MOST_LANGUAGES = 64
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(id_col: str, modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, piece by piece. Case is folded; each run of anything but letters and numerals such as ½ counts as one space."""
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    for at in range(0, len(letters), PIECE):
        points = np.frombuffer(letters[at : at + PIECE + max(LENGTHS) - 1].encode("utf-32-le"), np.uint32)
        for n in LENGTHS:
            if len(points) >= n:
                most = min(len(points) - n + 1, PIECE)
                h = np.full(most, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ points[k : k + most]) * np.uint32(MULTIPLIERS[k])
                    h ^= h >> np.uint32(15)
                yield h >> np.uint32(32 - BITS)


def gram_counts(text: str) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for g in grams(text):
        total += np.bincount(g, minlength=1 << BITS)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's counts of every language, as rows for those buckets that occur. A column of many values is counted in portions."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def portion() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(own[at], docs[lang]))], names=["lang", "bucket", "n"]
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in counts and len(counts) >= MOST_LANGUAGES:
                yield from portion()
            docs[lang] = docs.get(lang, 0) + 1
            own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            if text := text.as_py():
                for g in grams(text):
                    own += np.bincount(g, minlength=1 << BITS)
    yield from portion()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log-probabilities of buckets (a row each language) and log-priors, from all rows with a language.

    The counts of all partitions are summed in one aggregation. The driver gets the sums: a number for each language
    and bucket at most, whatever the corpus's size.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    sums = labelled.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(sums["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    counts, docs_of = np.zeros((len(langs), 1 << BITS)), np.zeros(len(langs))
    for lang, bucket, n in zip(sums["lang"], sums["bucket"], sums["n"]):
        if bucket < 0:
            docs_of[number[lang]] = n
        else:
            counts[number[lang], bucket] = n
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    return langs, logs, np.log(docs_of / max(docs_of.sum(), 1))


def judge(text: str | None, langs: list[str], priors: np.ndarray, by_bucket: np.ndarray) -> tuple[str, float]:
    """Only the buckets that occur in the text are looked up in the matrix."""
    if not langs or not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    counts = gram_counts(text)
    used = np.flatnonzero(counts)
    total = priors + counts[used] @ by_bucket[used]
    total = np.exp(total - total.max())
    return langs[int(total.argmax())], float(total.max() / total.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior probability) of each row's whole text.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. Ties go to the first language in
    order. The broadcast matrix has a fixed number of buckets for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, priors = shared.value
        by_bucket = np.ascontiguousarray(logs.T)
        for batch in batches:
            best, score = zip(*(judge(text.as_py(), langs, priors, by_bucket) for text in batch.column(1))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all.

    A row is held out if the CRC-32 of its identifier as text is 2 modulo 4. Rows without a language or with a null
    identifier teach nothing but are predicted. A prediction sees the text alone. Rows that repeat give a row each,
    an empty table none.
    """
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, in whose text a learned language is recognised with a score of `least` or more.

    Learned as in identify. Rows pass through the workers and need no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out(id_col)), text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, priors = shared.value
        by_bucket = np.ascontiguousarray(logs.T)
        for batch in batches:
            judged = (judge(text.as_py(), langs, priors, by_bucket) for text in batch.column(at))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
