"""Personal data: base patterns, and further spans that boosted trees select among candidates. DataFrame and SQL functions only."""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, written so that no text makes the engine go over it again and again: what can't match otherwise
#: is not given back, and a search begins only where a run does (or where the match before ended). A card's pattern has
#: the whole run of 13 to 19 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDED = {"email": "contains({t}, '@')", "ip": r"rlike({t}, r'[0-9]\.[0-9]')", "card": r"rlike({t}, r'[0-9][ -]?[0-9]')", "phone": r"rlike({t}, r'\+[0-9]')"}
#: High-recall generators of further candidates: disguised or unusual forms.
CANDIDATES = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[\[(] ?at ?[\])] ?| at )[a-z0-9-]{1,63}+(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[a-z0-9-]{1,63}+){1,5}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?: ?\[ ?\.? ?(?:dot)? ?\] ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ ./-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]{1,2}[0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])",
}
CANDIDATES_NEED = {"email": r"rlike({t}, r'(?i)[\[( ]at[\]) ]')", "ip": r"rlike({t}, r'[0-9] ?\[')", "card": r"rlike({t}, r'[0-9]{{4}}[ ._/-]')", "phone": r"rlike({t}, r'[0-9][) ./-]{{1,2}}[0-9]{{3}}')"}
#: Words in the 30 characters before a candidate that speak for its kind, or for another number.
FOR = {"email": "mail|contact|write|reach|address", "ip": "ip|host|server|address|login|from", "card": "card|visa|master|amex|credit|debit|pay", "phone": "phone|tel|call|fax|mobile|cell|contact|ring"}
AGAINST = "order|invoice|isbn|version|serial|item|ref|page|date|score|total|sku|part|meet|look|arriv"
REACH = 30
FEATURES = ["digits", "chars", "luhn", "joints", "for_it", "against", "kind", "tight"]
#: Precision on examples that weren't fitted that the threshold is set for.
PRECISION = 0.95


# ---- spans


def _found(text: str, pattern: str, needed: str) -> str:
    """array<struct<s,e,m>> of a pattern's matches as code points, e exclusive: the texts between matches give the places."""
    p = "r'" + pattern + "'"
    return f"""CASE WHEN {needed.format(t=text)} THEN
      aggregate(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, m) -> struct(length(gap) AS gap, m AS m)),
        struct(0 AS at, CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, m: STRING>>) AS out),
        (a, x) -> struct(a.at + x.gap + coalesce(length(x.m), 0) AS at,
          CASE WHEN x.m IS NULL THEN a.out ELSE concat(a.out, array(struct(a.at + x.gap AS s, a.at + x.gap + length(x.m) AS e, x.m AS m))) END AS out),
        a -> a.out) ELSE CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, m: STRING>>) END"""


_OCTET = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
VALID = {
    "email": "true",
    "ip": rf"forall(split(x.m, r'\.'), p -> rlike(p, r'{_OCTET}'))",
    "card": "luhn_check(regexp_replace(x.m, '[ -]', ''))",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def base_spans(text: str, kind: str) -> str:
    return f"filter({_found(text, BASE[kind], NEEDED[kind])}, x -> {VALID[kind]})"


# ---- features of candidates, in SQL and (for fitting) in Python


def _features_sql(text: str, kind: str) -> str:
    before = f"lower(substring({text}, greatest(x.s - {REACH}, 0) + 1, least(x.s, {REACH})))"
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    return f"""struct(x.s AS s, x.e AS e, '{kind}' AS k, CAST(length({digits}) AS DOUBLE) AS digits, CAST(x.e - x.s AS DOUBLE) AS chars,
      CAST(length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits}) AS DOUBLE) AS luhn, CAST(length(regexp_replace(x.m, r'[A-Za-z0-9]', '')) AS DOUBLE) AS joints,
      CAST(rlike({before}, r'(?:{FOR[kind]})') AS DOUBLE) AS for_it, CAST(rlike({before}, r'(?:{AGAINST})') AS DOUBLE) AS against, {float(KINDS.index(kind))}D AS kind,
      CAST(rlike(substring({text}, x.s, CASE WHEN x.s > 0 THEN 1 ELSE 0 END), r'[A-Za-z0-9_]') OR rlike(substring({text}, x.e + 1, 1), r'[A-Za-z0-9_]') AS DOUBLE) AS tight)"""


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def features(text: str, s: int, e: int, kind: str) -> list[float]:
    m, before = text[s:e], text[max(0, s - REACH) : s].lower()
    digits = re.sub("[^0-9]", "", m)
    near = re.search("[A-Za-z0-9_]", text[max(s - 1, 0) : s]) or re.search("[A-Za-z0-9_]", text[e : e + 1])
    return [len(digits), e - s, 13 <= len(digits) <= 19 and luhn(digits), len(re.sub("[A-Za-z0-9]", "", m)), bool(re.search(FOR[kind], before)), bool(re.search(AGAINST, before)), KINDS.index(kind), bool(near)]


def examples(n: int = 2400, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of invented candidates: each kind's forms after words that speak for it, against it or neither."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))

    def card(valid: bool) -> str:
        d = "4" + number(14)
        d = next(d + c for c in "0123456789" if luhn(d + c) == valid)
        return rng.choice([".", " - ", "_", "/", " . "]).join(d[i : i + 4] for i in range(0, 16, 4))

    made = {
        "email": lambda y: f"{word()}{rng.choice(['.', ''])}{word()}{rng.choice([' [at] ', '(at)', ' (at) ', ' at ']) if y else ' at '}{word()}{rng.choice([' [dot] ', '(dot)', ' dot ', '.']) if y else '.'}{rng.choice(['com', 'org', 'net', 'de']) if y else word()}",
        "ip": lambda y: rng.choice(["[.]", " [.] ", "[dot]"]).join(str(rng.randint(0, 255 if y else 999)) for _ in range(4)),
        "card": card,
        "phone": lambda y: rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"00{rng.randint(1, 9)}{number(1)} {number(3)} {number(3)}{number(4)}"]) if y else rng.choice([f"{number(4)}-{number(3)} {number(4)}", f"{number(2)}/{number(3)}{number(3)}", f"{number(3)} {number(4)}{number(3)}"]),
    }
    x, y = [], []
    for i in range(n):
        kind, label = KINDS[i % 4], rng.random() < 0.5
        hint = rng.random()
        cue = rng.choice(FOR[kind].split("|")) if hint < (0.75 if label else 0.1) else rng.choice(AGAINST.split("|")) if hint < (0.78 if label else 0.7) else word()
        before, after = f"{word()} {cue}{rng.choice([': ', ' ', ' no '])}", rng.choice([" ", ". ", ", "]) + word()
        found = made[kind](label)
        x.append(features(before + found + after, len(before), len(before) + len(found), kind))
        y.append(label)
    return np.array(x, float), np.array(y, float)


@cache
def model() -> tuple[list, float, float, float]:
    """Trees, the calibration's slope and intercept, and the least probability that has the precision asked for.

    Fitted on two thirds of the invented examples, calibrated and tested on the rest: a fixed number, nothing of the corpus.
    """
    x, y = examples()
    rest = np.arange(len(x)) % 12 >= 8
    trees = boosting.fit(x[~rest], y[~rest])
    z = boosting.value(trees, x[rest])
    a, b = boosting.calibrate(z, y[rest])
    p = boosting.sigmoid(a * z + b)
    least = min((t for t in np.round(np.arange(0.5, 1, 0.01), 2) if (p >= t).any() and y[rest][p >= t].mean() >= PRECISION), default=1.0)
    return trees, a, b, float(least)


def _selected(text: str, kind: str) -> str:
    """Candidates of a kind with a probability of the threshold or more: struct(s, e, k, p)."""
    trees, a, b, least = model()
    z = " + ".join(f"({boosting.as_sql(t, [f'c.{f}' for f in FEATURES])})" for t in trees)
    scored = f"transform(transform({_found(text, CANDIDATES[kind], CANDIDATES_NEED[kind])}, x -> {_features_sql(text, kind)}), c -> struct(c.s AS s, c.e AS e, c.k AS k, 1D / (1D + exp(-({a!r}D * ({z}) + {b!r}D))) AS p))"
    return f"filter({scored}, c -> c.p >= {least!r}D)"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, email, ip, card, phone (base spans) and added (further spans), each an array.

    Base spans are the leftmost non-overlapping matches of each kind that are valid: octets to 255, cards by Luhn's
    sum, phones of 9 to 15 digits. They always stay. Generators propose further, overlapping candidates; boosted trees
    score their format and the words before them, and those above the calibrated threshold are added unless they touch
    a base span, or overlap a candidate of a higher probability (of equal ones, the first).
    Places are code points, ends exclusive. A null or empty text has no spans; each row is judged alone, so that
    repeated rows and null identifiers give a row each. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    plain = "transform({}, x -> struct('{}' AS k, x.s AS s, x.e AS e))"
    rows = rows.select("doc_id", "t", *(F.expr(plain.format(base_spans("t", k), k)).alias(k) for k in KINDS), *(F.expr(_selected("t", k)).alias(f"more_{k}") for k in KINDS))
    rows = rows.select("doc_id", *KINDS, F.expr("concat(email, ip, card, phone)").alias("base"), F.expr("concat(more_email, more_ip, more_card, more_phone)").alias("more"))
    free = "filter(more, c -> NOT exists(base, b -> c.s < b.e AND b.s < c.e))"
    best = "filter(free, c -> NOT exists(free, o -> c.s < o.e AND o.s < c.e AND (o.p > c.p OR o.p = c.p AND (o.s < c.s OR o.s = c.s AND (o.e > c.e OR o.e = c.e AND o.k < c.k)))))"
    return rows.withColumn("free", F.expr(free)).select("doc_id", *KINDS, F.expr(f"transform({best}, c -> struct(c.k AS k, c.s AS s, c.e AS e))").alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, by kind in their order, then start, joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["k"]).alias("n"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with each span (array of k, s, e) replaced by its kind in brackets; of overlapping spans the first does it for all."""
    folded = f"""aggregate(array_sort(transform({spans}, x -> struct(x.s AS s, -x.e AS e, x.k AS k))), struct(0 AS at, '' AS out),
      (a, x) -> CASE WHEN x.s < a.at THEN struct(greatest(a.at, -x.e) AS at, a.out AS out)
        ELSE struct(-x.e AS at, concat(a.out, substring({text}, a.at + 1, x.s - a.at), '[', upper(x.k), ']') AS out) END,
      a -> concat(a.out, substring({text}, a.at + 1)))"""
    return F.expr(folded)
