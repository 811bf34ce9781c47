from pyspark.sql import functions as F

from docforge.operators import layout, tables

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_rows_and_columns_from_boxes(spark):
    rows = [("t", i, r * 20.0 + (i % 3), r * 20.0 + 12 + (i % 3), c * 100.0, c * 100.0 + 60) for i, (r, c) in enumerate((r, c) for r in range(4) for c in range(3))]
    df = spark.createDataFrame(rows, "t string, item_id int, y0 double, y1 double, x0 double, x1 double")
    got = {r.item_id: r.row_idx for r in tables.cluster_rows(df, "t").collect()}
    assert got == {i: i // 3 for i in range(12)}
    edges = tables.column_edges(df.join(tables.cluster_rows(df, "t"), ["t", "item_id"]), ["t"]).first().edges
    assert edges == [80.0, 180.0]
    grid = df.withColumn("col_edges", F.array(*map(F.lit, [0.0, 80.0, 180.0, 300.0]))).withColumn("row_edges", F.array(*map(F.lit, [0.0, 16.0, 36.0, 56.0, 90.0]))).withColumn("chars", F.lit(5))
    assert {(r.item_id, r.row, r.col, r.colspan) for r in tables.grid_place(grid).collect()} == {(i, i // 3, i % 3, 1) for i in range(12)}


def test_split_at_a_blank(spark):
    df = spark.createDataFrame([(1, "left right", (0.0, 0.0, 100.0, 10.0), [45.0]), (2, "whole", (0.0, 0.0, 50.0, 10.0), [25.0])], f"item_id int, text string, box {BOX}, edges array<double>")
    assert sorted((r.item_id, r.part, r.text) for r in tables.split_at_edges(df).collect()) == [(1, 0, "left"), (1, 1, "right"), (2, 0, "whole")]


def test_containers_and_labels(spark):
    r = spark.createDataFrame([("d", 1, 1, 0, (0.0, 0.0, 100.0, 100.0)), ("d", 1, 2, 1, (5.0, 5.0, 20.0, 20.0)), ("d", 1, 3, 2, (30.0, 5.0, 60.0, 20.0)), ("d", 1, 4, 3, (200.0, 0.0, 220.0, 20.0))], f"doc_id string, page int, region_id int, ord int, box {BOX}")
    assert {(x.region_id, x.is_container, x.container_group_id) for x in tables.containers(r).collect()} == {(1, True, 0), (2, False, 0), (3, False, 0), (4, False, None)}
    assert spark.range(1).select(tables.region_type(F.lit("Section_Header")).alias("t")).first().t == "title"


def test_boxes_fit_the_number_of_characters(spark):
    w = spark.createDataFrame([(1, 3, [(0.0, 10.0), (12.0, 14.0)]), (2, 1, [(0.0, 4.0), (5.0, 9.0)]), (3, 2, [(0.0, 1.0), (2.0, 3.0)])], "word_id int, want int, boxes array<struct<x0:double,x1:double>>")
    got = {r.word_id: ([tuple(b) for b in r.boxes], r.confidence) for r in tables.fit_boxes(w).collect()}
    assert got == {1: ([(0.0, 5.0), (5.0, 10.0), (12.0, 14.0)], 0.9), 2: ([(0.0, 9.0)], 0.9), 3: ([(0.0, 1.0), (2.0, 3.0)], 1.0)}


def test_element_stream(spark):
    b = lambda y, x=0.0: (x, float(y), x + 50, float(y) + 10)
    t = spark.createDataFrame([("d", 1, 1, b(100), "a | b")], f"doc_id string, page int, table_id int, box {BOX}, text string")
    r = spark.createDataFrame([("d", 1, 1, "HEADING", b(0)), ("d", 1, 2, "PARAGRAPH", b(101))], f"doc_id string, page int, region_id int, element_type string, box {BOX}")
    lines = spark.createDataFrame([("d", 1, 1001, "Title", b(0)), ("d", 1, 1002, "lost one", b(40)), ("d", 1, 1003, "lost two", b(52)), ("d", 1, 1004, "far", b(90, 300.0))], f"doc_id string, page int, line_id int, text string, box {BOX}")
    assigned = spark.createDataFrame([("d", 1001, 1)], "doc_id string, line_id int, region_id int")
    s = tables.elements(t, r, assigned, lines)
    assert [(x.element_type, x.text) for x in s.orderBy("reading_order_index").collect()] == [("HEADING", "Title"), ("PARAGRAPH", "lost one lost two"), ("PARAGRAPH", "far"), ("TABLE", "a | b")]
    assert tables.counters(s).first().observation_count == 4 and tables.elements_of(s).count() == 4


def test_lines_from_spans(spark):
    s = [("d", 2, 0, 0, 0, "Hel", (0.0, 0.0, 5.0, 5.0), 0, 9.0), ("d", 2, 0, 0, 1, "lo", (5.0, 0.0, 9.0, 6.0), 0, 9.0), ("d", 2, 0, 1, 0, " ", (0.0, 8.0, 5.0, 9.0), 0, 9.0), ("d", 2, 0, 2, 0, "white", (0.0, 8.0, 5.0, 9.0), 0xFFFFFF, 9.0), ("d", 2, 0, 3, 0, "red", (0.0, 8.0, 5.0, 9.0), 0xFF0000, 9.0)]
    df = spark.createDataFrame(s, f"doc_id string, page int, block_id int, line_id int, span_index int, text string, box {BOX}, color int, font_size double")
    assert [(r.observation_id, r.text, r.box.x1, r.box.y1) for r in layout.lines_from_spans(df).orderBy("observation_id").collect()] == [(2000, "Hello", 9.0, 6.0), (2001, "red", 5.0, 9.0)]
    h = df.limit(1).select(layout.drawing_hash(F.array(F.struct(F.lit("l").alias("op"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))), F.lit(1.0), F.lit(1.0)).alias("a"), layout.drawing_hash(F.array(F.struct(F.lit("l").alias("op"), F.lit(13.0).alias("x"), F.lit(14.0).alias("y"))), F.lit(11.0), F.lit(11.0)).alias("b")).first()
    assert h.a == h.b and len(h.a) == 16


def test_no_frame_of_the_reading_order_is_summed_anew_for_each_row(spark, capsys):
    e = spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 1, 7.0), (1, 3, 2, 1.0)], "doc int, rank int, page int, y0 double")
    o = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 1.0), (1, 12, 1, 1.0), (1, 13, 1, 6.0)], "doc int, orphan_id int, page int, y0 double")
    found = layout.reading_order(e, o, ["doc"])
    # an orphan beside an element comes before the next one; after the last element it comes last
    assert [(r.orphan_id, r.page, r.y0) for r in found.orderBy("reading_order_index").collect()] == [
        (12, 1, 1.0), (None, 1, 5.0), (10, 1, 5.0), (13, 1, 6.0), (None, 1, 7.0), (None, 2, 1.0), (11, 2, 1.0)
    ]
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out
