import datetime as dt
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docforge.functions import arrays, dates, fuzzy, geometry, jsonx, strings, values


def table(spark, values_, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_decimals(spark):
    got = table(spark, ["1,234.50", " 7 ", "", "x", "NaN", None, "-3.1", "1e3", "--1"], values.to_decimal)
    assert [None if x is None else float(x) for x in got] == [1234.5, 7, None, None, None, None, -3.1, 1000, None]
    assert [None if x is None else float(x) for x in table(spark, ["(100)", "RM 1,200.00", "abc"], values.normal_number)] == [-100, 1200, None]
    assert table(spark, ["-0.0123", "9", "$5", "0"], values.first_digit) == [1, 9, None, None]


def test_dates(spark):
    d = dt.date
    assert table(spark, ["2024-02-30", "2024-02-29", "2024/2/9", "9-2-2024", "09/02/2024", "9 feb 24", "9 Feb 75", "2023", None], dates.to_date) == [None, d(2024, 2, 29), *[d(2024, 2, 9)] * 4, d(1975, 2, 9), None, None]
    assert table(spark, ["300101", "310101", "991332", "12"], dates.yymmdd) == [d(2030, 1, 1), d(1931, 1, 1), None, None]
    assert table(spark, ["INV-20240315-1", "A2024.3.5", "5/3/2024", "5 March 2024", "99999999", "INV-20500101"], dates.reference_date) == [d(2024, 3, 15), d(2024, 3, 5), d(2024, 3, 5), d(2024, 3, 5), None, None]
    assert table(spark, ["2024:01:02 03:04:05+08:00", "D:20240102030405Z", "2024-01-02T03:04:05Z", "nope"], dates.to_timestamp) == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 3 + [None]
    assert table(spark, ["31.12.2023", "December 31, 2023", "31 December 2023"], dates.fuzzy_date) == [d(2023, 12, 31)] * 3
    said = lambda v: dates.mentioned(F.lit("2024-03-05").cast("date"), v)
    assert table(spark, ["on 5 March 2024", "05/03/2024", "Mar 5", "5 March 2023", "15 March 2024", "no date"], said) == [True, True, True, False, False, False]


def test_names_and_identifiers(spark):
    assert table(spark, ["Acme Sdn. Bhd.", "ACME &amp; Sons Berhad", "Böse-Werk Enterprise"], strings.company_name) == ["acme", "acme sons", "böse werk"]
    assert table(spark, [" rm ", "us$", "€", "xyz", ""], strings.currency) == ["MYR", "USD", "EUR", "XYZ", None]
    assert table(spark, ["https://www.a.co.uk/x?y", "user@host.example.com:80", "sub.site.com.my"], strings.domain) == ["a.co.uk", "example.com", "site.com.my"]
    assert table(spark, ["900101-14-1234", "901301-14-1234", "900101-99-1234", "12"], strings.mykad_fault) == [None, "date", "place", "format"]
    assert table(spark, ["http://g/search?a=1&q=x&b=2", "http://g/p?q=x"], strings.uri) == ["http://g/search?q=x", "http://g/p?q=x"]
    assert table(spark, ["g", "a", ".", "Q"], strings.glyph_class) == ["uncertain", "reliable", "excluded", "uncertain"]
    assert table(spark, ["C=MY, CN = Root CA, O=x", "none"], strings.common_name) == ["Root CA", None]
    assert table(spark, ["camelCase_key-name!"], strings.clean_key) == ["camel Case key name"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=40), min_size=1, max_size=20))
def test_ranges_expand_to_what_was_compressed(spark, lists):
    got = table(spark, lists, lambda v: F.struct(arrays.compress_ids(v).alias("c"), arrays.expand_ids(arrays.compress_ids(v)).alias("e")), "array<int>")
    assert [list(g.e) for g in got] == [sorted(set(x)) for x in lists]


def test_sample_ranges(spark):
    assert table(spark, [[1026, 1027, 1028, 1036, 2045, 2046, 2074, 2075, 2080]], arrays.compress_ids, "array<int>")[0] == ["1026-1028", "1036", "2045-2046", "2074-2075", "2080"]


def test_iou_is_symmetric_and_bounded(spark):
    rng = random.Random(4)
    rows = [tuple(float(rng.randint(0, 20)) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in ("a", "b", "c", "d", "e", "f", "g", "h")))
    a, b = geometry.box("a", "b", "c", "d"), geometry.box("e", "f", "g", "h")
    df = df.select(a.alias("p"), b.alias("q"))
    p, q = F.col("p"), F.col("q")
    for r in df.select(geometry.iou(p, q).alias("x"), geometry.iou(q, p).alias("y"), geometry.iou(p, p).alias("z"), geometry.area(p).alias("s")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and r.z == (1 if r.s > 0 else 0)


def test_reports(spark):
    texts = ['Here:\n```json\n{"summary": "s", "overall_risk": "HIGH", "risks": [{"risk": "r", "evidence_ids": ["E001"]}, {"risk": ""}]}\n```', '{"summary": "s", "overall_risk": "odd", "risks": []}', "none", '{"a": 1} x {']
    got = table(spark, texts, jsonx.report)
    assert (got[0].overall_risk, len(got[0].risks), got[1].overall_risk, got[2]) == ("high", 1, "medium", None)
    assert table(spark, ["INVOICE", "invoic", "Bank Statement", "zzz"], lambda v: jsonx.nearest_enum(v, ["INVOICE", "BANK_STATEMENT"])) == ["INVOICE", "INVOICE", "BANK_STATEMENT", None]


def test_fuzzy_scores_against_plain_definitions():
    import random

    from docforge.functions import fuzzy

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    def partial(a, b):
        a, b = sorted((a, b), key=len)
        parts = [b[i : i + len(a)] for i in range(len(b) - len(a) + 1)] + [b[:k] for k in range(1, len(a))] + [b[-k:] for k in range(1, len(a))]
        best = max((200 * lcs(a, p) / (len(a) + len(p)) for p in parts), default=0)
        if len(a) == len(b):
            best = max([best, *(200 * lcs(b, p) / (len(b) + len(p)) for p in [a[:k] for k in range(1, len(b))] + [a[-k:] for k in range(1, len(b))])])
        return best

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        assert abs(fuzzy.ratio(a, b) - 200 * lcs(a, b) / (len(a) + len(b))) < 1e-9
        assert abs(fuzzy.partial_ratio(a, b) - partial(a, b)) < 1e-9
    assert fuzzy.coverage("Telephone Bill 12.50", ["BP Telefhone", "bill", "RM 12.50"]) == 1.0
    assert fuzzy.coverage("Telephone", ["xyz"]) == 0.0 and fuzzy.coverage("--", []) == 1.0 and fuzzy.coverage("a1", None) == 0.0
    assert fuzzy.text_similarity("due total", "total due") == 1.0 and fuzzy.text_similarity("", "x") == 1.0


def test_fuzzy_columns_agree_with_the_functions(spark):
    from docforge.functions import fuzzy, strings

    rows = [("Telephone Bill", ["Telefhone", "bill"]), ("Telephone Bill", ["nothing"]), ("--", []), ("word", None), (None, ["x"]), ("Same text", ["same TEXT"])]
    got = spark.createDataFrame(rows, "value string, texts array<string>").select("value", "texts", fuzzy.token_coverage(F.col("value"), F.col("texts")).alias("c"), fuzzy.is_text_covered(F.col("value"), F.col("texts")).alias("ok")).collect()
    assert [(r.c, r.ok) for r in got] == [(fuzzy.coverage(v, t), fuzzy.coverage(v, t) >= 0.8) for v, t in rows]
    checked = spark.createDataFrame([("ab1",), ("12 34",), ("1234",), ("ab",), ("日本語",), (None,)], "t string").select(strings.should_check_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in checked] == [True, True, False, False, False, False]


def test_covered_tokens_are_those_that_score_one_by_one():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("abcdeAB é1.") for _ in range(rng.randrange(60))).strip()
        tokens = {"".join(rng.choice("abcdeABf1") for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 33, 70]))) for _ in range(6)} | {text[3:9].replace(" ", "x") or "a"}
        threshold = rng.choice([40, 60, 80, 90])
        assert not text or fuzzy.covered_tokens(tokens, text, threshold) == {t for t in tokens if fuzzy.token_score(t, text) >= threshold}


def test_pairs_compared_at_once(monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab c\0é𝒳.1") for _ in range(n))
    pairs = [(word(n), word(m)) for n in (0, 1, 2, 15, 16, 31, 32, 62, 63, 64) for m in (0, 1, 15, 16, 40, 63, 64, 90) for _ in range(2)] + [(w, w) for w in ("a", "bc")]
    values, texts = [a for a, _ in pairs] + [None], [[b, a[::-1]] for a, b in pairs] + [None]
    for stretches, most in ((1 << 15, 20_000), (30, 3)):
        monkeypatch.setattr(fuzzy, "STRETCHES", stretches)
        monkeypatch.setattr(fuzzy, "PAIRS", most)
        assert list(fuzzy.partial_ratios(pairs)) == [fuzzy.partial_ratio(*p) for p in pairs]
        for v, known, share in zip(values, texts, fuzzy.coverages(values, texts, [60] * len(values))):
            tokens = fuzzy.TOKEN.findall(v or "")
            met = sum(any(x.strip() and fuzzy.token_score(t, x.strip()) >= 60 for x in known or ()) for t in tokens)
            assert share == (met / len(tokens) if tokens else 1.0)


def test_a_thousand_pairs_of_lines_take_a_fraction_of_one_at_a_time():
    rng = random.Random(10)
    pairs = [tuple("".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(2)) for _ in range(1000)]
    start = time.perf_counter()
    got = fuzzy.text_similarities(pairs)
    at_once, start = time.perf_counter() - start, time.perf_counter()
    want = [max(fuzzy.token_sort_ratio(*p), fuzzy.partial_ratio(*p)) / 100 for p in ((a.strip(), b.strip()) for a, b in pairs)]
    assert got == want and at_once < (time.perf_counter() - start) / 2
