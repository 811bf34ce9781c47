"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 13
#: Bytes to a space unless they belong to a word: 0-9, a-z (after bytes.lower(), which leaves others than A-Z) and all from 0x80.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Benchmark text that one automaton takes, in characters: about 250 MB in a worker. A larger benchmark is searched in blocks of so much.
BLOCK_CHARS = 1_000_000
#: What stands for a word of the document that no item has.
UNKNOWN = "\x00\x00\x00"

SCHEMA = "doc_id {id}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, hits array<struct<start:bigint,end:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(WORDS).split()


def coded(number: int) -> str:
    """A word's number as three characters, of which the first is of another kind than the others: no match begins within a word."""
    return chr(256 + number // 16129) + chr(1 + number // 127 % 127) + chr(1 + number % 127)


def windows(items: list[tuple[str, str]], size: int = WINDOW) -> tuple[dict[bytes, str], dict[str, set[str]]]:
    """The code of each word, and each window as its words' codes with the items that have it."""
    codes: dict[bytes, str] = {}
    found: dict[str, set[str]] = {}
    for item, text in items:
        own = [codes.setdefault(w, coded(len(codes))) for w in words_of(text)]
        for i in range(max(1, len(own) - size + 1)) if own else ():
            found.setdefault("".join(own[i : i + size]), set()).add(item)
    return codes, found


_BUILT: dict[int, tuple] = {}


def automaton(key: int, items: list[tuple[str, str]], size: int):
    """(codes of words, automaton), built once in each Python worker and block."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        built = ahocorasick.Automaton()
        codes, found = windows(items, size)
        for window, of in found.items():
            built.add_word(window, (len(window) // 3, sorted(of)))
        if len(built):
            built.make_automaton()
        _BUILT[key] = (codes, built)
    return _BUILT[key]


def scan(text: str | None, found: tuple) -> tuple[int, int, list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """Words, hit words, items, spans of hit words as code points of the original text, and as numbers of words."""
    codes, built = found
    raw = (text or "").encode()
    blank = raw.lower().translate(WORDS)
    words = blank.split()
    if not words or not len(built):
        return len(words), 0, [], [], []
    ends, sizes, items = [], [], set()
    for end, (n, of) in built.iter("".join([codes.get(w, UNKNOWN) for w in words])):
        ends.append(end // 3 + 1)
        sizes.append(n)
        items.update(of)
    if not ends:
        return len(words), 0, [], [], []
    last = np.array(ends)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last - np.array(sizes), 1)
    np.add.at(marks, last, -1)
    hit = np.cumsum(marks[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    hits = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    is_word = np.frombuffer(blank, np.uint8) != 0x20
    turns = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # code points before each byte
    spans = [(int(points[turns[2 * a]]), int(points[turns[2 * b - 1]])) for a, b in hits]
    return len(words), int(hit.sum()), sorted(items), spans, hits


def _scanner(items: list[tuple[str, str]], size: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(key, items, size)
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, hit, of, spans, hits = zip(*(scan(t.as_py(), found) for t in batch.column(1))) if batch.num_rows else ((),) * 5
            as_pairs = lambda x: pa.array([[{"start": a, "end": b} for a, b in r] for r in x], pair)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(list(of), pa.list_(pa.string())), as_pairs(spans), as_pairs(hits)],
                names=["doc_id", "n_words", "n_hit", "items", "spans", "hits"],
            )

    return run


def _cleaner(items: list[tuple[str, str]], size: int, key: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(key, items, size)
        for batch in batches:
            judged = (scan(t.as_py(), found) for t in batch.column(at))
            yield batch.filter(pa.array([not (hit and 20 * hit >= n) for n, hit, *_ in judged], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, in as many blocks as its measured size asks for."""
    known = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter("item is not null")
    blocks = -(-(known.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block_chars) or 1
    for b in range(blocks):
        yield [(r["item"], r["text"]) for r in (known if blocks == 1 else known.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)).collect()]


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, written once so that the numbers hold, and that column's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def _marked(rows: DataFrame, row: str, text_col: str, blocks: list, size: int) -> DataFrame:
    """row, n_words, n_hit, items, spans of each row: the blocks' hits united."""
    plain = rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text"))
    parts = [plain.mapInArrow(_scanner(items, size, hash((size, tuple(items)))), SCHEMA.format(id="bigint")) for items in blocks]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p.filter(F.size("items") > 0))
    each = lambda c: F.flatten(F.collect_list(c))
    words = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1))))).cast("long")
    out = both.groupBy("doc_id", "n_words").agg(F.array_sort(F.array_distinct(each("items"))).alias("items"), F.array_sort(F.array_distinct(each("spans"))).alias("spans"), each("hits").alias("hits"))
    n_hit = F.when(F.size("hits") > 0, words).otherwise(F.lit(0).cast("long"))
    return out.select(F.col("doc_id").alias(row), "n_words", n_hit.alias("n_hit"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, that decontaminate doesn't call contaminated: each row by its own text, whatever its identifier.

    With one block they need no shuffle; with several, rows are numbered, and the contaminated ones' numbers taken out.
    """
    blocks = list(_blocks(benchmark, item_col, item_text, block_chars))
    if len(blocks) == 1:
        return docs.mapInArrow(_cleaner(blocks[0], size, hash((size, tuple(blocks[0]))), docs.columns.index(text_col)), docs.schema)
    rows, row = _numbered(docs)
    bad = _marked(rows, row, text_col, blocks, size).filter("n_hit > 0 and 20 * n_hit >= n_words").select(row)
    return rows.join(bad, row, "left_anti").select(docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items, spans, contaminated.

    Words are runs of 0-9, a-z and all characters from U+0080, A-Z in lower case. A window is `size` consecutive words
    of a benchmark item, or the whole item if it has fewer; a document's word inside any occurrence of a window is hit.
    items: identifiers of the items with occurring windows, as sorted strings. spans: the hit passages as code points
    of the original text, end exclusive. contaminated: a word in twenty is hit, at least.

    The benchmark's size is measured first; an automaton gets block_chars characters of it at most, and a larger
    benchmark is searched block by block (items are never divided), with the blocks' hits united for each document.
    A null or empty text has no words. Items with a null identifier or without words are passed over; an item listed
    twice counts once. An empty benchmark hits nothing, no documents give no rows. Rows that repeat give a row each, with
    one block or several. Extra columns are not read.
    """
    blocks = list(_blocks(benchmark, item_col, item_text, block_chars))
    if len(blocks) == 1:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        out = rows.mapInArrow(_scanner(blocks[0], size, hash((size, tuple(blocks[0])))), SCHEMA.format(id=dict(docs.dtypes)[id_col]))
    else:
        rows, row = _numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        out = rows.select(row, "doc_id").join(_marked(rows, row, "text", blocks, size), row)
    return out.select("doc_id", "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))
