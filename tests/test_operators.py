import random

from pyspark.sql import functions as F

from docforge.functions import strings
from docforge.operators import components, evidence, grounding, joins, layout, rules, stats, validation, visual

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(seed, n, pages=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randint(0, 180), rng.randint(0, 180)
        out.append((1, i % pages, i, (float(x), float(y), float(x + rng.randint(1, 90)), float(y + rng.randint(1, 90)))))
    return out


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return i / (area(a) + area(b) - i)


def test_greedy_assignment_is_the_smallest_region(spark):
    items, regions = boxes(1, 60), boxes(2, 30)
    want = {}
    for _, page, rid, r in sorted(regions, key=lambda r: ((r[3][2] - r[3][0]) * (r[3][3] - r[3][1]), r[2])):
        for _, p, i, b in items:
            cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
            if p == page and i not in want and (r[0] <= cx <= r[2] and r[1] <= cy <= r[3] or iou(b, r) >= 0.3):
                want[i] = rid
    a = spark.createDataFrame(items, f"doc_id int, page int, item_id int, box {BOX}")
    b = spark.createDataFrame(regions, f"doc_id int, page int, region_id int, other {BOX}").withColumn("ord", F.col("region_id"))
    got = {r.item_id: r.region_id for r in joins.assign_smallest(a, b, ["doc_id", "page"]).collect()}
    assert got == {i: want.get(i) for _, _, i, _ in items}


def test_pairs_of_boxes_against_all_pairs(spark):
    rows = boxes(3, 80)
    a = spark.createDataFrame(rows, f"doc_id int, page int, item_id int, box {BOX}")
    other = a.select("doc_id", "page", F.col("item_id").alias("o"), F.col("box").alias("other"))
    from docforge.functions import geometry as g

    got = [(r.item_id, r.o) for r in joins.box_pairs(a, other, ["doc_id", "page"], (F.col("item_id") < F.col("o")) & (g.iou(F.col("box"), F.col("other")) > 0.1), size=32.0).collect()]
    want = {(x[2], y[2]) for x in rows for y in rows if x[2] < y[2] and x[1] == y[1] and iou(x[3], y[3]) > 0.1}
    assert len(got) == len(set(got)) and set(got) == want


def test_unreachable(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(8)], "d int, id int")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 5, 6)], "d int, src int, dst int")
    roots = spark.createDataFrame([(1, 0)], "d int, id int")
    assert {r.id for r in components.unreachable(nodes, edges, roots, ["d"]).collect()} == {3, 4, 5, 6, 7}


def test_benford_passes_on_log_uniform_numbers(spark):
    rng = random.Random(7)
    rows = [("good", int(str(10 ** rng.uniform(1, 4))[0])) for _ in range(8000)] + [("flat", rng.randint(1, 9)) for _ in range(3000)] + [("few", 1)] * 20
    got = {r.k: r.zone for r in stats.benford(spark.createDataFrame(rows, "k string, d int"), ["k"], "d").collect()}
    assert got == {"good": "close", "flat": "failed"}


def test_width_outliers_and_overlaps(spark):
    rows = [("d", "F", 10.0, 0, "a", 5.0)] * 6 + [("d", "F", 10.0, 0, "a", 9.0)] + [("d", "F", 10.0, 0, c, 6.0) for c in "0123456789"] + [("d", "F", 10.0, 0, "e", 4.0 + i / 1000) for i in range(12)] + [("d", "F", 10.0, 0, "e", 7.0)]
    got = {(r.char, r.width) for r in visual.width_outliers(spark.createDataFrame(rows, "doc_id string, font string, size double, style int, char string, width double")).collect()}
    assert got == {("a", 9.0), ("e", 7.0)}
    chars = spark.createDataFrame([(1, 1, "s", i, c, (x, 0.0, x + 10, 10.0)) for i, (c, x) in enumerate([("a", 0.0), ("b", 9.5), ("c", 14.0), (",", 22.0)])], f"doc_id int, page int, span_id string, pos int, char string, box {BOX}")
    assert [(r.char, r.next) for r in visual.char_overlaps(chars).collect()] == [("b", "c")]


def test_occlusion_and_copy_move(spark):
    rows = [(1, 1, "t", 0, "text", False, 1.0, (0.0, 0.0, 10.0, 10.0)), (1, 1, "v", 1, "vector", True, 1.0, (0.0, 0.0, 12.0, 12.0)), (1, 1, "u", 2, "vector", False, 1.0, (0.0, 0.0, 12.0, 12.0)), (1, 1, "i", 3, "image", False, 1.0, (5.0, 2.0, 60.0, 60.0))]
    o = spark.createDataFrame(rows, f"doc_id int, page int, object_id string, z int, kind string, filled boolean, opacity double, box {BOX}")
    hit, near = visual.occlusions(o, least=0.9, near=0.3)
    assert {(r.object_id, r.hidden_id) for r in hit.collect()} == {("v", "t")} and {(r.object_id, r.hidden_id) for r in near.collect()} >= {("i", "t")}
    again = spark.createDataFrame([(1, 1, "t", "v")], "doc_id int, page int, first string, second string")
    assert visual.copy_move(hit, again).count() == 1 and visual.object_pool(o).first().n_vector == 2


def test_outlined_micro_and_baseline(spark):
    spans = spark.createDataFrame([(1, 1, "l", (0.0, 0.0, 50.0, 10.0)), (1, 1, "l", (70.0, 0.0, 100.0, 10.0))], f"doc_id int, page int, line_id string, box {BOX}")
    draw = spark.createDataFrame([(1, 1, 1, 5, (55.0, 1.0, 61.0, 9.0)), (1, 1, 2, 5, (20.0, 1.0, 26.0, 9.0)), (1, 1, 3, 0, (56.0, 1.0, 60.0, 9.0))], f"doc_id int, page int, item_id int, bezier_count int, box {BOX}")
    assert [r.item_id for r in visual.outlined(draw, spans).collect()] == [1]
    chars = spark.createDataFrame([(1, 1, 9, "x", 10.0, (0.0, 0.0, 5.0, 5.0))], f"doc_id int, page int, char_id int, char string, font_size double, other {BOX}")
    small = spark.createDataFrame([(1, 1, 1, (0.0, 0.0, 4.0, 4.0)), (1, 1, 2, (0.0, 0.0, 12.0, 1.0))], f"doc_id int, page int, item_id int, box {BOX}")
    zones = spark.createDataFrame([], f"doc_id int, page int, other {BOX}")
    hits, every = visual.micro_vectors(small, chars, zones)
    assert [r.item_id for r in hits.collect()] == [1] and every.count() == 1
    glyphs = spark.createDataFrame([(1, float(i), 100 + i * 0.5 + (6 if i == 7 else 0), 20.0, "reliable", 0.9) for i in range(12)], "line int, x double, bottom double, height double, class string, confidence double")
    assert [r.x for r in visual.baseline_outliers(glyphs, ["line"]).collect()] == [7.0]


def test_alignment_camera_and_consensus(spark):
    cells = [("d", 1, r, 0, 10.0 + (30 if r == 5 else 0), 50.0 + r * 7, 90.0 + r * 13) for r in range(9)]
    assert [r.row for r in visual.alignment_outliers(spark.createDataFrame(cells, "doc_id string, table_id int, row int, col int, left double, mid double, right double")).collect()] == [5]
    cam = spark.createDataFrame([(0.9, 3, 0.9), (0.05, 60, 0.2)], "solid double, peak_width int, concentration double")
    assert [r.source_type for r in visual.camera_score(cam).orderBy(F.desc("solid")).collect()] == ["digital", "camera"]
    regions = spark.createDataFrame([("d", 1, 1, "m1", 0.6, (0.0, 0.0, 10.0, 10.0)), ("d", 1, 2, "m2", 0.8, (1.0, 1.0, 10.0, 10.0)), ("d", 1, 3, "m1", 0.9, (50.0, 50.0, 60.0, 60.0)), ("e", 1, 4, "m1", 0.8, (0.0, 0.0, 5.0, 5.0))], f"doc_id string, page int, region_id int, model string, confidence double, box {BOX}")
    assert {(r.doc_id, r.label, r.n) for r in visual.consensus(regions).collect()} == {("d", 1, 2), ("e", 4, 1)}


def test_routes_of_the_sample(spark):
    kinds = ["BANK", "WEBSITE", "ORGANIZATION", "ORGANIZATION", "VENDOR", "PERSON", "CUSTOMER", "ADDRESS", "ACCOUNT"]
    t = spark.createDataFrame(list(enumerate(kinds)), "target_id int, entity_type string").withColumn("route", grounding.route(F.col("entity_type")))
    assert {r.route: r["count"] for r in t.groupBy("route").count().collect()} == {"bnm": 1, "whois": 1, "whitelist": 3, "unverifiable": 3, "enterprise": 1}
    none = t.select("target_id", F.lit("UNVERIFIABLE").alias("outcome"))
    assert {r.outcome for r in grounding.fallback(t, none).collect()} == {"UNVERIFIABLE"}
    asked = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "batch int, i int")
    said = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 3, "c")], "batch int, position int, index int, summary string")
    assert {r.i: r.summary for r in grounding.align_summaries(asked, said).collect()} == {0: "a", 1: None, 2: "c"}


def test_rules_that_cannot_be_planned_are_skipped(spark):
    facts = spark.createDataFrame([("d", 0, "TAX_RATE")], "doc_id string, ord int, role string")
    out = rules.run_rules({"facts": facts}).collect()
    assert {r.status for r in out} == {"skipped"}
    documents = spark.createDataFrame([("d", "invoice"), ("e", "resume")], "doc_id string, document_type string")
    assert {r.doc_id for r in rules.run_rules({"facts": facts, "documents": documents}).collect()} == {"d", "e"}


def test_future_is_judged_from_the_issue_date(spark):
    facts = spark.createDataFrame([("d", 0, "ISSUE_DATE", "2020-01-01"), ("d", 1, "DUE_DATE", "2020-03-01"), ("e", 0, "DUE_DATE", "2020-03-01"), ("e", 1, "DEADLINE", "2019-01-01")], "doc_id string, ord int, role string, day string")
    facts = facts.selectExpr("*", "CAST(day AS DATE) AS d", "CAST(NULL AS DECIMAL(18,6)) AS pct", "CAST(NULL AS DECIMAL(18,6)) AS amount")
    assert [(r.doc_id, r.actual) for r in rules.fact_results(facts, "2020-02-15").collect()] == [("d", "2020-03-01")]


def test_cells_and_structure(spark):
    lines = spark.createDataFrame([("d", 1, "Widget A 2 300.00"), ("d", 2, "3 May 2024")], "doc_id string, observation_id int, text string")
    cells = [("d", 0, 0, "PRODUCT", "Widget A", [1], [1]), ("d", 0, 0, "QUANTITY", "7", [1], [1]), ("d", 0, 3, "UNIT_PRICE", "7300.00", [1], [1]), ("d", 0, 4, "DESC", "Gadget nine", [1], [1]), ("d", 0, 5, "DESC", "Widqet A", [], [1]), ("d", 0, 6, "PERIOD_END", "2024-05-03", [2], [1]), ("d", 0, 1, "EVENT_DATE", "2024-05-03", [2], [1]), ("d", 0, 2, "EVENT_DATE", "03/05/2024", [2], [1]), ("d", 1, 0, "PRODUCT", "x", [], [])]
    got = {(r.table_ord, r.row_idx, r.kind) for r in validation.cells_against_lines(spark.createDataFrame(cells, "doc_id string, table_ord int, row_idx int, column string, value string, obs array<int>, table_obs array<int>"), lines).collect()}
    assert got == {(0, 3, "vlm_ocr_numeric_mismatch"), (0, 4, "vlm_ocr_text_mismatch"), (0, 2, "vlm_date_format_violation"), (1, None, "missing_source")}
    targets = spark.createDataFrame([("d", 0, "Widget A", [("k", "999999"), ("n", "no such name")], [1])], "doc_id string, ord int, value string, keys array<struct<key:string,value:string>>, obs array<int>")
    assert [(r.pos, r.kind) for r in validation.targets_against_lines(targets, lines).collect()] == [(1, "vlm_ocr_numeric_mismatch"), (2, "vlm_ocr_text_mismatch")]
    regions = spark.createDataFrame([("d", 1, True, "Widget A 2 300.00"), ("d", 2, True, "claimed"), ("d", 3, True, "")], "doc_id string, region_id int, is_text boolean, text string")
    assigned = spark.createDataFrame([("d", 1, 1)], "doc_id string, observation_id int, region_id int")
    pages = spark.createDataFrame([("d", 1)], "doc_id string, page int")
    got = {(r.item, r.kind) for r in validation.structure_conflicts(lines, regions, assigned, pages, spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")).collect()}
    assert got == {("2", "unassigned_observation"), ("2", "region_without_lines"), ("3", "empty_region"), ("2", "grid_missed_table")}


def test_amounts_for_first_digits_are_those_of_the_tables_type(spark):
    rows = [("d", 0, "bank_transactions", {"FLOW_OUT": "1,200.50", "FLOW_IN": None, "AMOUNT": "7"}), ("d", 1, "PAYROLL", {"AMOUNT": "9"}), ("d", 2, "OFFICIAL", {"AMOUNT": "5"}), ("d", 3, None, {"AMOUNT": "5"})]
    got = rules.benford_amounts(spark.createDataFrame(rows, "doc_id string, table_ord int, table_type string, cells map<string,string>")).collect()
    assert {(r.table_ord, r["column"], float(r.amount)) for r in got} == {(0, "FLOW_OUT", 1200.5), (1, "AMOUNT", 9.0)}


def test_spans_far_off_the_page_make_no_line(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [("in", (10.0, 10.0, 50.0, 20.0)), ("edge", (-15.0, 10.0, -5.0, 20.0)), ("left", (-90.0, 10.0, -30.0, 20.0)), ("right", (630.0, 10.0, 650.0, 20.0)), ("below", (10.0, 830.0, 50.0, 840.0))]
    spans = spark.createDataFrame([("d", 1, 0, i, 0, t, b, 0, 10.0, 600.0, 800.0) for i, (t, b) in enumerate(rows)], f"doc_id string, page int, block_id int, line_id int, span_index int, text string, box {box}, color int, font_size double, page_width double, page_height double")
    assert {r.text for r in layout.lines_from_spans(spans).collect()} == {"in", "edge"}


def test_values_are_cut_one_by_one(spark):
    d = spark.createDataFrame([("a" * 800,), ("b" * 801,), (None,)], "v string")
    assert [r.c for r in d.select(evidence.cut_text(F.col("v")).alias("c")).collect()] == ["a" * 800, "b" * 800 + "... (truncated)", None]
    names = spark.createDataFrame([("A &amp; B Sdn Bhd",)], "n string").select(strings.company_name(F.col("n")).alias("a"), strings.company_name(F.col("n"), entities=False).alias("b")).first()
    assert tuple(names) == ("a b", "a amp b")
