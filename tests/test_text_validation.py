"""The text branches of cross validation against a row-by-row version."""

import re

import pyarrow.parquet as pq

from docforge import catalog
from docforge.functions import fuzzy

DIR = "/root/testdata/sf0.001"


def checked(v):
    v = v.strip(" ")
    return len(v) >= 3 and bool(re.search("[A-Za-z]", v) or re.search(r"\d\s+\d", v))


def covered(value, texts):
    tokens = fuzzy.TOKEN.findall(value)
    known = [t.strip() for t in texts if t.strip()]
    return not tokens or sum(any(fuzzy.token_score(t, x) >= 80 for x in known) for t in tokens) / len(tokens) >= 0.8


def test_against_a_row_by_row_version(spark):
    rows = pq.read_table(f"{DIR}/conversations.parquet").to_pylist()
    text = {(str(r["conv_id"]), r["turn"]): r["text"] or "" for r in rows}
    want = set()
    for (doc, turn), t in text.items():
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
        seen = text.get((doc, turn - 1), "")
        values = [" ".join(words[::-1][:3]), words[2] if len(words) > 2 else None, str(turn * 1111)]
        for pos, v in enumerate(values):
            if v is None or not seen:
                continue
            digits = re.sub(r"[^0-9.\-]", "", v)
            if len(re.findall("[0-9]", v)) >= 4 and sum(c.isalpha() for c in v) <= 2:
                numbers = [re.sub(r"[^0-9.\-]", "", x) for x in re.findall(r"\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?", seen)]
                if re.fullmatch(r"-?\d+(\.\d+)?", digits) and not any(re.fullmatch(r"-?\d+(\.\d+)?", x) and abs(float(x)) == abs(float(digits)) for x in numbers) and v not in seen:
                    want.add((doc, f"target.{turn}.{pos}", "vlm_ocr_numeric_mismatch"))
            elif checked(v) and not covered(v, [seen]):
                want.add((doc, f"target.{turn}.{pos}", "vlm_ocr_text_mismatch"))
        own = [] if turn % 3 == 0 else [t]
        near = own or [text[doc, k] for k in (0, 1) if (doc, k) in text]
        v = " ".join(words[:4])
        if near and checked(v) and not covered(v, near):
            want.add((doc, f"cell.{turn}", "vlm_ocr_text_mismatch"))
        claim = (t if turn % 2 == 0 else text.get((doc, turn + 1), ""))[:60]
        if turn % 5 == 4:
            want.add((doc, f"page.{turn}", "unassigned_observation"))
            want.add((doc, f"page.{turn}", "region_without_lines" if claim.strip(" ") else "empty_region"))
        elif claim.strip(" ") and fuzzy.text_similarity(claim, t[:60]) < 0.7:
            want.add((doc, f"page.{turn}", "text_differs"))
    got = {tuple(r) for r in catalog.queries()["text_cross_validation"](spark, DIR).select("doc_id", "item", "kind").collect()}
    got = {g for g in got if g[2] != "missing_source"}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    assert {"vlm_ocr_text_mismatch", "text_differs", "unassigned_observation"} <= {k for _, _, k in got}


def test_comparisons_are_not_gathered_in_few_tasks(spark):
    from pyspark.sql import functions as F

    from docforge.operators import validation

    lines = spark.range(40).select((F.col("id") % 4).cast("string").alias("doc_id"), F.col("id").cast("int").alias("observation_id"), F.lit("some text").alias("text"))
    rows = lines.select("doc_id", F.col("observation_id").alias("row_id"), F.array("observation_id").alias("obs"))
    found = validation.cited(rows, lines)
    assert found.count() == 40
    # adaptive execution joins partitions of few bytes unless their number is asked for
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_regions_are_compared_by_their_whole_texts(spark, tmp_path):
    words = lambda k: " ".join(f"{chr(97 + k)}{chr(97 + i % 23)}{i * k % 97}" for i in range(150))
    same, other, third = "one beginning that all of these turns have in common, of seventy letters ", words(3), words(7)
    # turn 1 claims the text of turn 2: alike in their first sixty characters only in conversation 1, everywhere but there in conversation 2
    rows = [(1, 1, "user", same + other), (1, 2, "user", same + third), (2, 1, "user", "x" * 60 + other), (2, 2, "user", "y" * 60 + other)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["text_cross_validation"](spark, str(tmp_path)).filter("kind = 'text_differs'").select("doc_id", "item").collect()
    assert {tuple(r) for r in got} == {("1", "page.1")}


def test_alike_is_text_similarity_against_a_limit():
    import random

    draw = random.Random(5)
    for _ in range(1500):
        a = "".join(draw.choices("ab c", k=draw.randint(0, 40)))
        b = a[draw.randint(0, 8) :] + "".join(draw.choices("ab cd", k=draw.randint(0, 30))) if draw.random() < 0.5 else "".join(draw.choices("ab cd", k=draw.randint(0, 90)))
        for least in (0.0, 0.5, 0.7, 0.75, 0.9, 1.0):
            assert fuzzy.alike(a, b, least) == (fuzzy.text_similarity(a, b) >= least), (a, b, least)
