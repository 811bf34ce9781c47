"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import words_of

#: Buckets of hashed features, features that the classifier uses, classifiers that are averaged.
BITS, CHOSEN, MEMBERS = 20, 512, 3
#: Bounds of the sample that the classifiers are fitted on: toxic documents, and documents of unknown label.
MOST_POSITIVE, MOST_UNLABELLED = 2000, 6000
#: A word's features are itself and its beginnings of these lengths, so that inflected forms share most of them.
PREFIXES = (4, 5, 6)


def held_out(id_col: str, modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def buckets_of(word: bytes) -> tuple[int, ...]:
    import xxhash

    text = word.decode()
    forms = [f"={text}", *(f"{n}{text[:n]}" for n in PREFIXES if len(text) >= n)]
    return tuple(xxhash.xxh32_intdigest(f) >> (32 - BITS) for f in forms)


class _Features(dict):
    """A word's features among those that count (or all, if none are given), remembered."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.number = None if chosen is None else {int(x): i for i, x in enumerate(chosen)}
        self.used = None if chosen is None else {x % (1 << BITS) for x in self.number}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        found = buckets_of(word)
        if self.used is not None:
            found = tuple(x for x in found if x in self.used)
        self[word] = found
        return found


def features(text: str | None, known: _Features) -> np.ndarray:
    """The features that occur in the text, in order: x where a word has it, and x + 2 ** BITS where two words do."""
    counts: dict[int, int] = {}
    for word, n in Counter(words_of(text)).items():
        for x in known[word]:
            counts[x] = counts.get(x, 0) + n
    found = [*counts, *(x + (1 << BITS) for x, n in counts.items() if n > 1)]
    if known.number is not None:
        found = [known.number[x] for x in found if x in known.number]
    return np.array(sorted(found), np.int64)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Features()
    for batch in batches:
        found = [features(t.as_py(), known).astype(np.int32) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "features"])


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, g[self.row], size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(p: _Rows, u: _Rows, prior: float, scale: np.ndarray, steps: int = 300, decay: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the class-prior-corrected risk of the logistic loss,

        prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

    where R_p(+) is the loss of positive rows as positive and so on. Where the corrected negative part falls below zero
    the step goes up along it instead, as non-negative learning asks. Features are scaled by their log-odds.
    """
    w, b = np.zeros(len(scale)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        own = w * scale
        zp, zu = p.dot(own) + b, u.dot(own) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_positive, gp_negative, gu = -prior * _sigmoid(-zp) / p.n, -prior * _sigmoid(zp) / p.n, _sigmoid(zu) / u.n
        if negative >= 0:
            gp, gn = gp_positive + gp_negative, gu
        else:
            gp, gn = -gp_negative, -gu
        g = scale * (p.back(gp, len(w)) + u.back(gn, len(w))) + decay * w
        gb = gp.sum() + gn.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return w * scale, b


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: int = CHOSEN, members: int = MEMBERS):
    """(features that count, weights, intercept), averaged over classifiers that see different parts of the unlabelled rows."""
    size = 2 << BITS
    np_, nu = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    share_p = (in_p + 0.5) / (np_ + 1)
    share_n = np.maximum(in_u / nu - prior * in_p / np_, 0) / (1 - prior) + 0.5 / (nu + 1)
    odds = np.log(share_p / share_n)
    weight = np.where(in_p >= 2, in_p / np_ * np.abs(odds), 0)  # what a feature tells about a toxic document, on average
    use = np.sort(np.argsort(-weight, kind="stable")[:chosen])
    use = use[weight[use] > 0]
    number = {int(x): i for i, x in enumerate(use)}
    pick = lambda rows: _Rows([np.array([number[x] for x in r.tolist() if x in number], np.int64) for r in rows])
    p, weights, intercepts = pick(positive), [], []
    for k in range(members):
        part = [r for i, r in enumerate(unlabelled) if members == 1 or nu < 50 * members or i % members != k]
        w, b = fit_nnpu(p, pick(part), prior, odds[use])
        weights.append(w)
        intercepts.append(b)
    return use, np.mean(weights, axis=0), float(np.mean(intercepts))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED):
    """The classifier, from toxic documents and unlabelled ones that aren't held out.

    The class prior is the share of toxic labels among all labels that aren't held out: it is counted, not estimated from
    positive and unlabelled rows. The samples are the documents
    with the smallest hashes of their identifiers: most_positive of those labelled toxic, most_unlabelled of all. The
    sample's identifiers are broadcast (a bounded number), its features go to the driver.
    None if there is nothing to learn from.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("doc_id is not null and label is not null").filter(~held_out("doc_id"))
    share = known.agg(F.avg((F.col("label") > 0).cast("double")).alias("prior")).first()["prior"]
    if not share or share >= 1:
        return None
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # labels without a document take no place in the sample, an identifier that repeats takes one
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").filter(~held_out("doc_id")).distinct()
    sample = by_hash(known.filter("label > 0").select("doc_id").distinct().join(ids, "doc_id", "left_semi"), most_positive).withColumn("positive", F.lit(True)).unionByName(by_hash(ids, most_unlabelled).withColumn("positive", F.lit(False)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("positive", "doc_id").agg(F.min("text").alias("text")).select("positive", "text")
    got = texts.mapInArrow(_collected, "positive boolean, features array<int>").toArrow()
    positive, unlabelled = [], []
    for is_p, found in zip(got.column(0).to_pylist(), got.column(1)):
        (positive if is_p else unlabelled).append(found.values.to_numpy().astype(np.int64))
    return fit(positive, unlabelled, share) if positive and unlabelled else None


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the estimated probability that the whole text is toxic. Without a model all scores are 0."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Features(model[0]) if model else None
        for batch in batches:
            z = [model[1][features(t.as_py(), known)].sum() + model[2] for t in batch.column(1)] if model else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(np.array(z)) if model else np.zeros(batch.num_rows), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    Learned from labels and texts of rows that aren't held out (CRC-32 of the identifier as text not 0 modulo 5). A
    score depends on the text alone. Null and empty texts get the score of a text without features; rows with a null
    identifier are scored and teach nothing; labels that are null or have no document teach nothing; repeated rows give
    a row each; where there is no toxic label to learn from, or no other, scores are 0. Further columns are not read.
    """
    out = score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
