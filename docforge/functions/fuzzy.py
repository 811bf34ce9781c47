"""Similarity of strings by their longest common subsequence, as whole-number bits; Arrow functions, for what containment alone doesn't decide."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

TOKEN = re.compile(r"[A-Za-z]+|\d+(?:[.,]\d+)?")


def _places(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _common(at: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of the string that `at` places and b."""
    row = full = (1 << n) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 200.0 * _common(_places(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a stretch of the longer one that is as long, or shorter at either end."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    best = 0.0
    for first, second in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        at = _places(first)
        for i in range(len(second) - n + 1):
            best = max(best, 200.0 * _common(at, n, second[i : i + n]) / (2 * n))
        for k in range(n - 1, 0, -1):
            if 200.0 * k / (n + k) <= best:
                break
            best = max(best, *(200.0 * _common(at, n, part) / (n + k) for part in (second[:k], second[-k:])))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_score(token: str, text: str) -> int:
    """100 if either contains the other in any case, else the whole part of partial_ratio."""
    low, other = token.lower(), text.lower()
    return 100 if low in other or other in low else int(partial_ratio(token, text))


#: Stretches of texts that are compared at a time, and pairs of strings that are held for it.
STRETCHES = 1 << 15
PAIRS = 20_000
#: Fills texts up at both ends: no text has it.
_FILL = "\ud800"


def _compared(tokens: np.ndarray, parts: list[tuple[int, int, int, int, str]], best: np.ndarray) -> None:
    """Raises best by the ratios of stretches; parts: number of the token, length of its text, first stretch, number of stretches, what they cover of the filled text."""
    n = tokens.shape[1]
    kind = np.uint16 if n < 16 else np.uint32 if n < 32 else np.uint64
    of, long, low, count = (np.array(c) for c in list(zip(*parts))[:4])
    points = np.frombuffer("".join(p[4] for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = count + n - 1
    starts = np.cumsum(sizes) - sizes
    masks = np.zeros(len(points), kind)
    for i in range(n):
        masks |= (points == np.repeat(tokens[of, i], sizes)).astype(kind) << kind(i)
    full = kind((1 << n) - 1)
    row = np.full(len(points) - n + 1, full, kind)
    for j in range(n):
        u = row & masks[j : j + len(row)]
        row = ((row + u) | (row - u)) & full
    at = (np.arange(len(points)) - np.repeat(starts, sizes))[: len(row)]
    first = at + (np.repeat(low, sizes) - (n - 1))[: len(row)]  # where the stretch begins in its text
    size = np.minimum(first + n, np.repeat(long, sizes)[: len(row)]) - np.maximum(first, 0)
    within = at < np.repeat(count, sizes)[: len(row)]
    np.maximum.at(best, of, np.maximum.reduceat(np.where(within, 200.0 * (n - np.bitwise_count(row).astype(np.int64)) / (n + size), 0.0), starts))


def _best_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The best ratio of each pair's first string (of 63 code points at most) to a stretch of its second, which isn't shorter: their partial_ratio, if it is longer.

    All stretches of all pairs of one length meet at once: the common subsequence's bits, one array operation for each place in a stretch. The
    texts are filled up at both ends, so that the shorter stretches there are those whose other places match nothing.
    """
    out = np.zeros(len(pairs))
    by_size: dict[int, list[int]] = {}
    for k, (token, _) in enumerate(pairs):
        by_size.setdefault(len(token), []).append(k)
    for n, same in by_size.items():
        tokens = np.frombuffer("".join(pairs[k][0] for k in same).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        best, parts, held, fill = np.zeros(len(same)), [], 0, _FILL * (n - 1)
        for j, k in enumerate(same):
            text = pairs[k][1]
            filled, every = fill + text + fill, len(text) + n - 1
            for low in range(0, every, STRETCHES):
                w = min(STRETCHES, every - low)
                parts.append((j, len(text), low, w, filled[low : low + w + n - 1]))
                held += w
                if held >= STRETCHES:
                    _compared(tokens, parts, best)
                    parts, held = [], 0
        if parts:
            _compared(tokens, parts, best)
        out[same] = best
    return out


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """partial_ratio of each pair, all at once where the shorter string is of 63 code points at most."""
    out, at, ways = np.zeros(len(pairs)), [], []
    for k, (a, b) in enumerate(pairs):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if not a or len(a) > 63 or a in b:
            out[k] = partial_ratio(a, b)
            continue
        for way in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
            at.append(k)
            ways.append(way)
    np.maximum.at(out, np.array(at, np.int64), _best_ratios(ways))
    return out


def covered_tokens(tokens: set[str], text: str, threshold: int) -> set[str]:
    """The tokens whose token_score with the text is `threshold` or more."""
    low = text.lower()
    found = {t for t in tokens if t.lower() in low or low in t.lower()}
    left = list(tokens - found)
    return found | {t for t, r in zip(left, partial_ratios([(t, text) for t in left])) if int(r) >= threshold}


def coverages(values: Sequence[str | None], texts: Sequence[Sequence[str] | None], thresholds: Sequence[int]) -> list[float]:
    """For each value the share of its tokens that score the threshold in one of its texts; 1 without tokens, 0 without texts."""
    rows, pairs, whose = [], [], []

    def told() -> None:
        for (n, t), r in zip(whose, partial_ratios(pairs)):
            if int(r) >= thresholds[n]:
                rows[n][1].discard(t)
        pairs.clear()
        whose.clear()

    for n, (value, known) in enumerate(zip(values, texts)):
        tokens = TOKEN.findall(value or "")
        known = [t.strip() for t in known if t and t.strip()] if tokens and known is not None else []
        lows = [t.lower() for t in known]
        left = {t for t in tokens if not any(t.lower() in x or x in t.lower() for x in lows)}
        rows.append((tokens, left))
        # what one of the texts contains needs no ratio
        for t in left:
            pairs += [(t, x) for x in known]
            whose += [(n, t)] * len(known)
        if len(pairs) >= PAIRS:
            told()
    told()
    return [sum(t not in left for t in tokens) / len(tokens) if tokens else 1.0 for tokens, left in rows]


def coverage(value: str | None, texts: Sequence[str] | None, threshold: int = 80) -> float:
    """`coverages` of one value."""
    return coverages([value], [texts], [threshold])[0]


def text_similarities(pairs: list[tuple[str | None, str | None]]) -> list[float]:
    """0 to 1 for each pair: the larger of the ratio of sorted tokens and the partial ratio; 1 if either is blank."""
    pairs = [((a or "").strip(), (b or "").strip()) for a, b in pairs]
    at = [k for k, (a, b) in enumerate(pairs) if a and b and a != b]
    out = [1.0] * len(pairs)
    for k, r in zip(at, partial_ratios([pairs[k] for k in at])):
        out[k] = (100.0 if r == 100 else max(token_sort_ratio(*pairs[k]), float(r))) / 100
    return out


def text_similarity(a: str | None, b: str | None) -> float:
    """`text_similarities` of one pair."""
    return text_similarities([(a, b)])[0]


def _reaches(a: str, b: str, least: float) -> bool:
    """Whether partial_ratio(a, b) / 100 is `least` or more, for strings of any length.

    The common subsequence of a stretch grows by one at most with each place that the stretch moves on, so that places are left out from which it
    can't be long enough yet. What it has in common with all beginnings, and all ends, of the longer string is told by one pass each.
    """
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n or a in b:
        return (100.0 if n or not b else 0.0) / 100 >= least
    enough = min((k for k in range(n + 1) if 200.0 * k / (2 * n) / 100 >= least), default=n + 1)
    for first, second in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        at, i, full = _places(first), 0, (1 << n) - 1
        while i <= len(second) - n:
            common = _common(at, n, second[i : i + n])
            if common >= enough:
                return True
            i += enough - common
        for places, end in ((at, second[: n - 1]), (_places(first[::-1]), second[::-1][: n - 1])):
            row = full
            for k, c in enumerate(end, 1):
                u = row & places.get(c, 0)
                row = ((row + u) | (row - u)) & full
                if 200.0 * k / (n + k) / 100 >= least and 200.0 * (n - row.bit_count()) / (n + k) / 100 >= least:
                    return True
    return False


def alike(a: str | None, b: str | None, least: float) -> bool:
    """Whether text_similarity(a, b) is `least` or more, by less work on long texts."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b or a == b:
        return least <= 1
    return token_sort_ratio(a, b) / 100 >= least or _reaches(a, b, least)


@F.pandas_udf(DoubleType())
def _coverage(value: pd.Series, texts: pd.Series, threshold: pd.Series) -> pd.Series:
    return pd.Series(coverages(value.tolist(), texts.tolist(), threshold.tolist()), dtype="float64")


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(text_similarities(list(zip(a, b))), dtype="float64")


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y, z) for x, y, z in zip(a, b, least)], dtype="bool")


def contained_share(value: Column, texts: Column) -> Column:
    """The share of value's tokens that one of the texts contains, without regard to case: never more than coverage. Null without tokens."""
    own = F.regexp_extract_all(value, F.lit("(" + TOKEN.pattern + ")"), F.lit(1))
    found = F.filter(own, lambda t: F.exists(texts, lambda x: F.contains(F.lower(x), F.lower(t))))
    return F.when(F.size(own) > 0, F.try_divide(F.size(found), F.size(own)))


def token_coverage(value: Column, texts: Column, threshold: int = 80) -> Column:
    """`coverage` as a column; containment is looked at first. The arguments are plain columns, as Python functions don't take lambdas' results."""
    return _coverage(value, texts, F.lit(threshold))


def is_text_covered(value: Column, texts: Column, least: float = 0.8, threshold: int = 80) -> Column:
    return token_coverage(value, texts, threshold) >= least


def similarity(a: Column, b: Column) -> Column:
    return _similarity(a, b)


def is_alike(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) >= least."""
    return _alike(a, b, F.lit(float(least)))
