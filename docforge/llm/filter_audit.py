"""Interaction audit of quality filters: what each removes after each other, counted on packed bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_lookup

#: The filters by letter; the bit of each in a row's `fails` is its place here.
FILTERS = "ABCDE"
DUPLICATE = FILTERS.index("E")
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
#: Parts that a task counts at a time; with more it gives out what it has and goes on.
MOST_PARTS = 1000

FACTS = "doc_id {id}, part string, fails int, digest binary"
COUNTS = "part string, before int, filter int, failing bigint, removed bigint, kept bigint, alone bigint, good_lost bigint, toxic_lost bigint"
SUMS = ("failing", "removed", "kept", "alone", "good_lost", "toxic_lost")


def failed(raw: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = raw.split()  # on 0x20 and 0x09 to 0x0D
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < 50 * len(words)
    b = np.frombuffer(raw, np.uint8)
    capitals = 100 * int(((b >= 65) & (b <= 90)).sum()) > 2 * int(((b & 0xC0) != 0x80).sum())
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | repeated << 1 | capitals << 2 | symbols << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t.as_py() or "").encode() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(failed, raw), pa.int32()), pa.array((hashlib.sha256(r).digest() for r in raw), pa.binary())],
            names=["doc_id", "part", "fails", "digest"],
        )


class Bitmaps:
    """Bitmaps, eight rows a byte, of one part's rows: those that fail each filter, the good and the toxic ones."""

    def __init__(self, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        self.all = np.packbits(np.ones(len(fails), bool))
        self.fails = [np.packbits((fails >> k) & 1) for k in range(len(FILTERS))]
        self.good, self.toxic = np.packbits(good), np.packbits(toxic)

    def counts(self) -> np.ndarray:
        """[set of filters applied before, filter, one of SUMS]; zeros where the set has the filter."""
        n = len(FILTERS)
        ones = lambda x: int(np.bitwise_count(x).sum())
        left = [self.all]  # by set of filters: the rows that pass them all
        for s in range(1, 1 << n):
            top = s.bit_length() - 1
            left.append(left[s ^ (1 << top)] & ~self.fails[top])
        out = np.zeros((1 << n, n, len(SUMS)), np.int64)
        for s in range(1 << n):
            for f in range(n):
                if not s >> f & 1:
                    gone = left[s] & self.fails[f]
                    alone = left[(1 << n) - 1 ^ 1 << f] & self.fails[f]
                    out[s, f] = ones(self.fails[f]), ones(gone), ones(left[s | 1 << f]), ones(alone), ones(gone & self.good), ones(gone & self.toxic)
        return out


def _rows(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(FILTERS)
    each = [(p, s, f, *c[s, f].tolist()) for p, c in found.items() for s in range(1 << n) for f in range(n) if not s >> f & 1]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(SUMS)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*each) if each else [()] * len(kinds), kinds)], names=["part", "before", "filter", *SUMS])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        of = parts.indices.to_numpy()
        fails, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        for k, p in enumerate(parts.dictionary.to_pylist()):
            own = of == k
            found[p] = found.get(p, 0) + Bitmaps(fails[own], good[own], toxic[own]).counts()
        if len(found) > MOST_PARTS:
            yield _rows(found)
            found.clear()
    yield _rows(found)


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, part, fails (bits of the filters A to E), good, toxic.

    Of equal texts those with a larger identifier than the smallest fail E: a group is summed to its smallest identifier by digest, and its rows
    meet that through salts. Only digests with two identifiers come back.
    """
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    facts = cut(plain.mapInArrow(_facts, FACTS.format(id=kind)).withColumn("row", F.monotonically_increasing_id()))
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    firsts = firsts.filter("first < last or (nulls > 0 and first is not null)").select("digest", "first")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    marked = spread_lookup(facts, firsts, "digest", "row", how="left").withColumn("fails", F.col("fails").bitwiseOR(F.when(later, 1 << DUPLICATE).otherwise(0)))
    label = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    labelled = labels.filter("doc_id is not null").groupBy("doc_id").agg(label("quality"), label("toxic"))
    met = spread_lookup(marked.select("doc_id", "part", "fails", "row"), labelled, "doc_id", "row", n=16, how="left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return met.select("doc_id", "part", "fails", yes("quality").alias("good"), yes("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters, by what fails: A fewer than 200 words (runs of other characters than 0x20 and 0x09 to 0x0D); B fewer distinct words than half of them;
    C more than two in a hundred characters in A-Z; D any of # $ % & * |; E the text of a smaller identifier, wherever that is in the table.
    A filter's step is its place in the order; kept and removed are rows after it and by it, redundant rows that fail it but went
    before, unique_fails rows that fail it alone, good_lost and toxic_lost removed rows with that label, shapley what it removes in all orders together.

    Each task packs its rows' failures and labels into bitmaps by part, and counts for each set of filters that can stand before a filter, by AND-NOT and
    popcount: 80 rows a part and task, whose sums are all that is shuffled. The 120 orders are read off those sums.

    A null text counts as empty (it fails A); a null part is the empty string; a null identifier comes after all others in E and has no labels; of rows with
    equal text and identifier none fails for the other. A document with several rows of labels has a label that any of them has. Rows that repeat count each.
    Empty docs give no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = failures(docs, labels, id_col, text_col, part_col)
    counted = rows.select("part", "fails", "good", "toxic").mapInArrow(_counted, COUNTS).groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in SUMS))
    n = len(FILTERS)
    weight = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range((1 << n) - 1)}  # orders in which just the set s stands before a given filter
    steps = [("".join(FILTERS[f] for f in o), k + 1, sum(1 << f for f in o[:k]), o[k]) for o in permutations(range(n)) for k in range(n)]
    orders = spark.createDataFrame([(*s, weight[s[2]]) for s in steps], "filter_order string, step int, before int, filter int, weight long")
    counted = cut(counted)
    met = counted.join(F.broadcast(orders.select("before", "filter", "weight").distinct()), ["before", "filter"])
    shapley = met.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    out = counted.join(shapley, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])
    return out.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost", "shapley"
    )
