import random
import re

import numpy as np
from pyspark.sql import functions as F

from docforge.llm import boosting, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(PATTERNS[k], text or "") if valid(k, m[0])] for k in pii.KINDS}


def texts():
    rng = random.Random(5)
    bits = ["1", "4111 1111 1111 1111", "4111111111111111", "42", ".", "-", " ", "@", "a", "b.co", "x_y%z+", "é", "🙂", "+1 (755) 555-9729", "+", "(", ")", "192.168.0.255", "256.1.1.1", "1.2.3.4", "0000000000000", "\n", "mail "]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return out + [None, "", "a@b.co_m@x.yz", "1.2.3.4.5.6.7.8", "a" * 60_000 + " @", "1." * 5_000, "1 " * 20_000, "@" * 3_000 + "a.b@c", "x@y" + ".z" * 20_000, "+1" + "-" * 20_000, "1@a." * 2_000]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        own = {k: [(x.s, x.e) for x in r[k]] for k in pii.KINDS}
        assert own == brute(rows[r.doc_id][1]), rows[r.doc_id][1][:200]
        assert not [x for x in r.added for k in pii.KINDS for s, e in own[k] if x.s < e and s < x.e]


def test_features_are_those_the_trees_were_fitted_on(spark):
    samples = [("call me: ", "(755) 555-9729", " now", "phone"), ("order ", "4000 - 1234 - 5678 - 9017", "", "card"), ("é🙂 mail ", "a.b [at] c [dot] de", "x", "email"), ("", "10[.]0[.]0[.]1", "", "ip")]
    for before, m, after, kind in samples:
        text = before + m + after
        df = spark.createDataFrame([(text, len(before), len(before) + len(m), m)], "t string, s int, e int, m string").select("t", F.struct("s", "e", "m").alias("x"))
        row = df.select(F.expr(pii._features_sql("t", kind)).alias("f")).first().f
        assert [row[n] for n in pii.FEATURES] == [float(v) for v in pii.features(text, len(before), len(before) + len(m), kind)]


def test_disguised_forms_are_added_and_other_numbers_are_not(spark):
    rows = [(1, "please write: jane.doe [at] example [dot] org today"), (2, "my phone (755) 555-9729, thanks"), (3, "server 10[.]0[.]0[.]1 is down"), (4, "invoice 1234-567 8901 of may"), (5, "look at this. part 12/345678")]
    got = {r.doc_id: [x.k for x in r.added] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["email"], 2: ["phone"], 3: ["ip"], 4: [], 5: []}


def test_listing_and_redaction(spark):
    text = "🙂 a@b.co, +1 (755) 555-9729; 1.2.3.4 or 4111 1111 1111 1111."
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("all", F.concat(*pii.KINDS, "added")).withColumn("t", F.lit(text))
    row = found.select(pii.listed(F.col("all")).alias("l"), pii.redacted("t", "all").alias("r")).first()
    assert row.l == ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in brute(text)[k])
    assert row.r == "🙂 [EMAIL], [PHONE]; [IP] or [CARD]."


def test_empty_table_and_no_python_in_the_plan(spark, capsys):
    found = pii.find_pii(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == []
    found.explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_boosting_learns_and_is_calibrated():
    x, y = pii.examples(seed=99)
    trees, a, b, least = pii.model()
    p = boosting.sigmoid(a * boosting.value(trees, x) + b)
    assert np.mean((p >= 0.5) == y) > 0.85 and y[p >= least].mean() >= 0.9 and abs(p.mean() - y.mean()) < 0.05
