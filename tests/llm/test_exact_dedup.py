import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docforge.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        own = groups[norm := re.sub(r"[\x20\x09-\x0d]", "", t or "")]
        keep = min(own)[3]
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    return sorted(map(tuple, exact_dedup(docs, **kw).collect()), key=repr)


def test_nulls_blanks_ties_and_repeats(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (7, "é"), (7, "é"), (None, "z"), (9, "z"), (10, "x" * 200_000), (11, "x "), (12, "x")]
    assert got(spark, rows) == brute(rows)


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(900)]
    assert got(spark, rows) == got(spark, rows, fan_in=2, rounds=4) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n", max_size=4), min_size=1, max_size=30))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)
