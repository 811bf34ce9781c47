"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import classes
from .common import cut, release, spread_lookup

#: Words in a k-mer, and entries of a sketch; an entry keeps two minima.
K, ENTRIES = 5, 64
#: The same of the second sketch, whose short k-mers stand between edits that come every few words.
SHORT_K, SHORT_ENTRIES = 2, 32
SIMILARITY = 0.8
#: Bits that say of how many words with a certain hash a text has an odd number; texts of more than half as many words have finer ones besides.
PARITY = 512
#: Bytes to a space unless they belong to a word: letters and digits of ASCII and all from 0x80.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Hash values of a document that are held at once: they stay in a core's cache.
CELLS = 1 << 16
_ODD = np.random.RandomState(20).randint(0, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.RandomState(21).randint(0, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A number to mix in and an odd one to multiply with for each hash function of a sketch.
_SEED = np.random.RandomState(24).randint(0, 1 << 32, 256, np.uint32)
_TIMES = np.random.RandomState(25).randint(0, 1 << 31, 256, np.uint32) * np.uint32(2) + np.uint32(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(WORDS).split()


class _Hashes(dict):
    """64-bit hashes of the words that a worker has met; begun anew when they are MOST_WORDS."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


#: Words whose hashes a worker remembers at most.
MOST_WORDS = 1 << 17
_HASHES = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers in text order; a shorter text is one k-mer."""
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += h[j : j + n] * _ODD[j]
    s = mixed(s)
    ordered = np.sort(s)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(s, kind="stable")
        same = np.concatenate(([False], s[order[1:]] == s[order[:-1]]))
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
        # a first occurrence keeps its hash, so that it is the same in texts with and without repeats
        s = np.where(nth > 0, mixed(s + nth * _ODD[10]), s)
    return s


def sketch(s: np.ndarray, entries: int = ENTRIES, first: int = 0) -> np.ndarray:
    """For each of the hash functions from `first` on, its two smallest k-mers put back in text order, as one hash."""
    n = len(s)
    if not n:
        return s
    least, second = np.zeros(entries, np.int64), np.full(entries, n - 1)
    step, high = max(1, CELLS // n), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, entries if n > 2 else 0, step):
        of = slice(at, min(at + step, entries))
        v = high[None, :] ^ _SEED[first + of.start : first + of.stop, None]
        v *= _TIMES[first + of.start : first + of.stop, None]
        least[of] = v.argmin(axis=1)
        v[np.arange(len(v)), least[of]] = np.iinfo(np.uint32).max
        second[of] = v.argmin(axis=1)
    number = np.arange(first, first + entries).astype(np.uint64) + np.uint64(77)
    return mixed(mixed(number * _ODD[11] + s[np.minimum(least, second)]) * _ODD[11] + s[np.maximum(least, second)])


def entries_of(h: np.ndarray) -> np.ndarray:
    """The keys under which a text of these word hashes meets others: of both sketches, whatever its length."""
    return np.concatenate((sketch(kmers(h)), sketch(kmers(h, SHORT_K), SHORT_ENTRIES, ENTRIES)))


def parity(h: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """`bits` bits as 64-bit numbers: whether the number of words in each of so many bins is odd. An edit changes two of them at most."""
    return np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8).view(np.int64)


def fine_parity(h: np.ndarray) -> np.ndarray:
    """parity in the power of two of bits from twice the hashes on; empty where PARITY are so many."""
    bits = 1 << max(2 * len(h) - 1, 0).bit_length()
    return parity(h, bits) if bits > PARITY else np.zeros(0, np.int64)


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two fine parities differ, the longer one folded to the other's length; 0 where one is empty or they are of quite different lengths."""
    half = F.least(F.size(a), F.size(b))
    folded = lambda p: F.when(F.size(p) > half, F.zip_with(F.slice(p, 1, half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(p)
    count = F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when((half > 0) & (F.greatest(F.size(a), F.size(b)) <= 2 * half), count).otherwise(0)


def may_be_alike(a: Column, b: Column, least: float = SIMILARITY, numbers: int = PARITY // 64, fine: bool = False) -> Column:
    """False only if the edit similarity of two texts is surely less: by their numbers of words (n), by the bits of parity (p), and then by finer ones (fine)."""
    most = F.floor(F.greatest(a["n"], b["n"]) * (1 - least) + 1e-9)
    differ = sum(F.bit_count(a["p"][i].bitwiseXOR(b["p"][i])) for i in range(numbers))
    coarse = (F.abs(a["n"] - b["n"]) <= most) & (differ <= 2 * most)
    # fine bits are looked at only where the others leave a pair
    return coarse & (_differ(a["fine"], b["fine"]) <= 2 * most) if fine else coarse


def _may_be_alike(a: Column, b: Column) -> Column:
    return may_be_alike(a, b, fine=True)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            digests, counts, rows, odd, fine = [], [], [], [], []
            for text in part.column(1):
                text = text.as_py() or ""
                words = words_of(text)
                digests.append(xxhash.xxh3_128_digest(b"w" + b" ".join(words) if words else b"r" + text.encode()))
                counts.append(len(words))
                h = hashed(words)
                rows.append(entries_of(h).view(np.int64))
                # each occurrence of a word is another one: of a word that comes often, parity would else say nothing
                each = kmers(h, 1)
                odd.append(parity(each))
                fine.append(fine_parity(each))
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(odd, pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "digest", "n", "sketch", "p", "fine"],
            )
    release()


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of two sequences without their common beginning and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    return a[: len(a) - end], b[: len(b) - end]


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two word sequences if it is `most` or less, else None.

    The alignment stays within a band of `most` on either side of the diagonal. A column of the band is held as bits of
    whole numbers, that say where the distance grows (up) or falls (down) from a row to the next, and moves down by a row
    each step (Hyyro's form of Myers's algorithm). The distance is followed along the band's lower edge, then along the last row.
    """
    if abs(len(a) - len(b)) > most:
        return None
    a, b = trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return d if (d := len(a)) <= most else None
    if len(a) - shared_words(a, b) > most:
        return None
    k = min(most, len(a))
    rows: dict[int, int] = {}
    for n, word in enumerate(a.tolist()):
        rows[word] = rows.get(word, 0) | 1 << n
    lower = 1 << 2 * k
    band = 2 * lower - 1
    up, down, distance, turn = band & ~((1 << k) - 1), 0, k, len(a) - k
    left = len(b) - turn  # steps along the last row
    for column, word in enumerate(b.tolist(), 1):
        at = column - k - 1
        same = rows.get(word, 0)
        same = (same >> at if at >= 0 else same << -at) & band
        diagonal = ((((same & up) + up) ^ up) | same | down) & band
        rises = down | (band & ~(diagonal | up))
        falls = diagonal & up
        if column <= turn:
            distance += not diagonal & lower
            if distance - left > most:
                return None
        else:
            at_end = lower >> (column - turn)
            distance += bool(rises & at_end) - bool(falls & at_end)
        up = falls | (band & ~((diagonal >> 1) | rises))
        down = (diagonal >> 1) & rises
    return distance if distance <= most else None


def chained(a: np.ndarray, b: np.ndarray, k: int = 3) -> int:
    """The edits of one alignment of two word sequences, so their distance or more.

    It goes along the k-mers that occur once in either, by the longest chain that rises in both: words beside each other between
    two of them on one diagonal are compared, gaps between diagonals count whole.
    """
    if min(len(a), len(b)) < k:
        return max(len(a), len(b))
    once = []
    for h in (a, b):
        grams = sum((h[j : len(h) - k + 1 + j] * _ODD[j] for j in range(k)), np.zeros(len(h) - k + 1, np.uint64))
        value, at, n = np.unique(grams, return_index=True, return_counts=True)
        once.append((value[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    p, q = once[0][1][i], once[1][1][j]
    order = np.argsort(p)
    p, q = p[order], q[order]
    tails, last, before = [], [], []
    for n, y in enumerate(q.tolist()):
        at = bisect_left(tails, y)
        tails[at : at + 1] = [y]
        last[at : at + 1] = [n]
        before.append(last[at - 1] if at else -1)
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(n)
        n = before[n]
    p, q = p[chain[::-1]], q[chain[::-1]]
    edits = x = y = 0  # x and y: words of a and b that are aligned
    turns = np.flatnonzero(np.diff(p - q)) + 1
    for start, end in zip([0, *turns], [*turns, len(p)]) if len(p) else ():
        skip = max(0, x - p[start], y - q[start])
        from_a, from_b, to_a = p[start] + skip, q[start] + skip, p[end - 1] + k
        if from_a < to_a:
            edits += max(from_a - x, from_b - y) + int((a[from_a:to_a] != b[from_b : from_b + to_a - from_a]).sum())
            x, y = to_a, from_b + to_a - from_a
    return int(edits + max(len(a) - x, len(b) - y))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Edit similarity of words, 1 - distance / the longer length, is `least` or more, by the cheapest bound that decides it."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    if max(len(a), len(b)) <= most or (len(a) == len(b) and (a != b).sum() <= most):
        return True
    return shared_words(a, b) >= max(len(a), len(b)) - most and (chained(a, b) <= most or distance_within(a, b, most) is not None)


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two sequences have in common in any order."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words, compressed: what is compared, in half the bytes of the text."""
    import zstandard

    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(b" ".join(words_of(t.as_py()))) for t in batch.column(1)], pa.binary())], names=["x", "words"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    last, center = None, None
    for batch in batches:
        good = []
        for number, own, other in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if number != last:
                last, center = number, hashed(unpack(other.as_py()).split())
            good.append(similar(hashed(unpack(own.as_py()).split()), center))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["x", "center", "good"])
    release()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest identifier of its class), kept (doc_id = class_id), text_hash (xxhash64 of its text).

    1. Words are runs of letters and digits in lower case. Texts of equal words are one class from the start; what
       follows has each text once.
    2. Order MinHash: for each of 64 hash functions the two smallest occurrence-labelled k-mers of five words, in text
       order, are an entry, and for each of 32 others the two smallest of two words: an edit in every fifth word leaves no k-mer of five, but
       three in five of the short ones. Texts with an equal entry are in one bucket.
    3. Pairs of a bucket are aligned: similar if the edit similarity of their words is 0.8 or more. All texts of a bucket are
       compared with its smallest identifier, and in buckets that aren't of one class then all texts of different classes with each other
       (`buckets.classes`). Pairs are passed over only within a class, or where a lower bound of their distance says that they can't be similar.
    4. Classes are the connected components of the similar pairs.

    Of pairs with a fifth of their words substituted, at random or every fifth, more than 97 in 100 share an entry, at any length, with a sixth and less nearly
    all (`tests/llm/test_near_dedup.py`). Nothing is sampled or capped.
    A null text counts as empty; texts without words are copies only if they are equal. Rows that share an identifier
    share a class if one of them has links. A null identifier makes no links; it gets the class of its copies, or null.
    Ties go to the smallest identifier. An empty table gives no rows; further columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashes = plain.withColumn("text_hash", F.xxhash64("text"))
    rows = cut(hashes.mapInArrow(_sketches, f"doc_id {kind}, text_hash bigint, digest binary, n int, sketch array<bigint>, p array<bigint>, fine array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sketch", "n", "p", "fine"))
    texts = cut(rows.groupBy("digest").agg(first.alias("first")).select("digest", F.col("first.doc_id").alias("x"), "first.sketch", F.struct("first.n", "first.p", "first.fine").alias("own")))
    known = texts.filter("x is not null")
    content = None

    def verified(pairs: DataFrame, everyone: DataFrame) -> DataFrame:
        nonlocal content
        if content is None:
            # merged and not broadcast: the number of these texts grows with the corpus
            content = cut(plain.mapInArrow(_packed, f"x {kind}, words binary").join(everyone.hint("merge"), "x").dropDuplicates(["x"]))
        own = pairs.join(content.hint("merge"), "x").select("x", "center", F.col("words").alias("own"))
        both = own.join(content.withColumnRenamed("x", "center").hint("merge"), "center")
        return both.select("x", "center", "own", "words").mapInArrow(_verify, f"x {kind}, center {kind}, good boolean").filter("good")

    members = known.select("x", F.explode("sketch").alias("key"))
    labels = classes(members, known.select("x", "own").dropDuplicates(["x"]), verified, _may_be_alike)
    texts = texts.select("digest", "x")
    if labels is not None:
        texts = texts.join(labels.withColumnRenamed("id", "x"), "x", "left").withColumn("x", F.coalesce("label", "x"))
    return spread_lookup(rows.select("doc_id", "text_hash", "digest"), texts.select("digest", F.col("x").alias("class_id")), "digest", "doc_id").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "text_hash"
    )
