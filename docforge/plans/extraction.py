"""Tables from rules, objects of files, mask regions, lines of glyphs, domains, schema errors. Files, drawings and masks are made of rows of the tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains, schemas
from ..functions import geometry as g
from ..operators import grids, joins, masks, pdfs, ransac
from ..sources.pdf_objects import pdf_objects
from .base import query, table

# ---- ruled tables: a page for each order, a row for each line item


#: Line items of the pages that a task has at a time. By runs with two sizes each task takes some seconds whatever its items, so that few large ones are
#: better; with so many, none spilled on eight cores that share a heap of 12 GB.
ITEMS = 300_000


def _drawings(spark, sf_dir) -> DataFrame:
    """Each line item draws its row: upper and lower rule, each in two strokes a point apart; four uprights (two for one item in three, whose first cells are merged);
    an upright that crosses nothing, and one that crosses a single rule. Every third order draws its cells as boxes instead."""
    y = F.col("y")
    line = lambda x0, y0, x1, y1: F.struct(F.lit("line").alias("kind"), g.box(F.lit(x0), y + y0, F.lit(x1), y + y1).alias("box"))
    rect = lambda x0, x1: F.struct(F.lit("rect").alias("kind"), g.box(F.lit(x0), y, F.lit(x1), y + 20).alias("box"))
    strokes = [line(50, d + o, 201, d + o) for d in (0, 20) for o in (0, 1)] + [line(200, d + o, 350, d + o) for d in (0, 20) for o in (0, 1)]
    frame, inner, loose = [line(x, 0, x, 21) for x in (50, 250, 350)], line(150, 0, 150, 21), [line(100, 6, 100, 14), line(300, 10, 300, 30)]
    merged = F.col("l_linenumber") % 3 == 0
    boxes = F.when(merged, F.array(rect(50, 250), rect(250, 350))).otherwise(F.array(rect(50, 150), rect(150, 250), rect(250, 350)))
    ruled = F.concat(F.array(*strokes, *frame), F.when(merged, F.array(*loose)).otherwise(F.array(inner)))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", (100 + 20 * F.col("l_linenumber")).alias("y"))
    li = joins.spread(li, "page", most=ITEMS).distinct()  # rows are dealt by page before they draw
    return li.select("page", F.explode(F.when(F.col("page") % 3 == 0, boxes).otherwise(ruled)).alias("d")).select("page", "d.*")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY page ORDER BY n) AS island FROM l),
c AS (SELECT page, n, island, unnest(CASE WHEN n % 3 = 0 THEN [50, 250] ELSE [50, 150, 250] END) AS x0 FROM i), o AS (SELECT *, CASE WHEN page % 3 = 0 THEN 0.0 ELSE 0.5 END AS shift FROM c)
SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY island) - 1 AS table_id, dense_rank() OVER (PARTITION BY page, island ORDER BY n) - 1 AS row, dense_rank() OVER (PARTITION BY page, island ORDER BY x0) - 1 AS col,
x0::DOUBLE AS x0, 100 + 20 * n + shift AS y0, CASE x0 WHEN 250 THEN 350.0 WHEN 150 THEN 250.0 ELSE CASE WHEN n % 3 = 0 THEN 250.0 ELSE 150.0 END END AS x1, 120 + 20 * n + shift AS y1 FROM o""")
def grid_tables(spark, sf_dir):
    """Cells of the ruled tables of all pages: snapped and joined rules, crossings, least rectangles, tables by shared corners."""
    found = grids.table_cells(_drawings(spark, sf_dir), ["page"])
    return found.select("page", "table_id", "row", "col", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


# ---- PDF files: one for each document, written by Spark

def _files(spark, sf_dir) -> DataFrame:
    """A file for each document: a catalogue, k = doc_id % 4 + 1 pages in a tree of two levels, one image for each source, notes, an orphan, and for every fifth a second revision."""
    i = F.col("doc_id")
    k = (i % 4 + 1).cast("int")
    n = lambda c: c.cast("string")
    obj = lambda num, body: F.concat(n(num) if not isinstance(num, int) else F.lit(str(num)), F.lit(" 0 obj\n"), *[x if not isinstance(x, str) else F.lit(x) for x in body], F.lit("\nendobj\n"))
    pixels = F.rpad(F.coalesce("source", F.lit("")), 16, "#")
    page = lambda p: obj(10 + p, ["<< /Type /Page /Parent 3 0 R /Contents ", n(50 + p), " 0 R >>"])
    draw = lambda p: F.concat(F.lit("q 100 0 0 50 20 "), n(p * 10), F.lit(" cm /Im0 Do Q"))
    content = lambda p: obj(50 + p, ["<< /Length ", n(F.length(draw(p))), " >>\nstream\n", draw(p), "\nendstream"])
    pages = F.transform(F.sequence(F.lit(1), k), lambda p: F.concat(page(p), content(p)))
    kids = F.array_join(F.transform(F.sequence(F.lit(1), k), lambda p: F.concat(n(10 + p), F.lit(" 0 R"))), " ")
    action = F.when(i % 7 == 0, F.lit(" /OpenAction 6 0 R")).otherwise(F.lit(""))
    script = F.when(i % 7 == 0, obj(6, ["<< /S /JavaScript /JS (app.alert\\(1\\)) >>"])).otherwise(F.lit(""))
    form = F.when(i % 3 == 0, F.lit(" /AcroForm << /Fields [] >>")).otherwise(F.lit(""))
    first = F.concat(
        F.lit("%PDF-1.7\n"), obj(1, ["<< /Type /Catalog /Pages 2 0 R", action, form, " >>"]), obj(2, ["<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 600 800] /Resources << /XObject << /Im0 4 0 R >> >> >>"]),
        obj(3, ["<< /Type /Pages /Parent 2 0 R /Kids [", kids, "] >>"]), obj(4, ["<< /Subtype /Image /Width ", n(F.length(pixels)), " /Height 1 /Length ", n(F.length(pixels)), " >>\nstream\n", pixels, "\nendstream"]),
        F.array_join(pages, ""), script, obj(5, ["<< /Title (kept out) >>"]), F.lit("trailer\n<< /Root 1 0 R >>\n"))
    second = F.when(i % 5 == 0, obj(5, ["<< /Title (changed) /Launch (x) >>"])).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select(i.cast("string").alias("path"), F.concat(first, second).cast("binary").alias("content"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 2 * (doc_id % 4 + 1) + 5 + (doc_id % 7 = 0)::INT AS total_objects, doc_id % 4 + 2 AS total_streams, (doc_id % 7 = 0)::INT AS javascript, (doc_id % 5 = 0)::INT AS launch,
doc_id % 3 = 0 AS has_acroform, doc_id % 7 = 0 AS open_action, 0 AS broken FROM documents""")
def pdf_graph(spark, sf_dir):
    """Object counts and active content of each file."""
    return pdfs.graph(pdf_objects(_files(spark, sf_dir))).select("doc_id", "total_objects", "total_streams", "javascript", "launch", "has_acroform", "open_action", "broken")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 5 AS obj, CASE WHEN doc_id % 5 = 0 THEN '/Title: changed' ELSE '/Title: kept out' END AS snippet FROM documents""")
def pdf_orphans(spark, sf_dir):
    """Objects that no path leads to from the root; of two objects with one number and revision the file's later one holds."""
    return pdfs.orphans(pdf_objects(_files(spark, sf_dir))).select("doc_id", "obj", "snippet")


@query("""WITH d AS (SELECT doc_id, rpad(CASE WHEN length(coalesce(source, '')) > 16 THEN left(source, 16) ELSE coalesce(source, '') END, 16, '#') AS px, unnest(range(1, doc_id % 4 + 2)) AS page FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, 'p' || page || '_i0' AS image_id, 4 AS obj, 16 AS width, md5(px) AS digest, 20.0 AS x0, 750.0 - page * 10 AS y0, 120.0 AS x1, 800.0 - page * 10 AS y1 FROM d""")
def pdf_images(spark, sf_dir):
    """Where each page paints each image, with the digest of its bytes: page tree, inherited resources, content matrices."""
    p = pdfs.placements(pdf_objects(_files(spark, sf_dir)))
    return p.select("doc_id", "page", "image_id", "obj", "width", "digest", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


# ---- masks: a page for 200 orders, a row of 60 pixels for each; its items are short bars


def _mask_rows(spark, sf_dir) -> DataFrame:
    bar = F.struct((F.col("l_partkey") % 60).cast("int").alias("x"), F.floor(F.col("l_quantity") / 25).cast("int").alias("r"), F.col("l_linenumber").alias("k"))
    bars = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(bar).alias("b"))
    score = lambda x: F.coalesce(F.array_max(F.transform(F.filter("b", lambda b: F.abs(b["x"] - x) <= b["r"]), lambda b: 0.5 + b["k"] / 20)), F.lit(0.0))
    return bars.select(F.floor(F.col("l_orderkey") / 200).alias("page"), (F.col("l_orderkey") % 200).alias("y"), F.transform(F.sequence(F.lit(0), F.lit(59)), score).alias("scores"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey // 200 AS page, l_orderkey % 200 AS y, x, max(0.5 + l_linenumber / 20.0) AS s FROM lineitem, (SELECT unnest(range(60)) AS x) WHERE abs(l_partkey % 60 - x) <= floor(l_quantity / 25) GROUP BY ALL),
r AS (SELECT page, y, min(x) AS x0, max(x) AS x1, count(*) AS n, sum(s) AS total FROM (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS island FROM p) GROUP BY page, y, island),
e AS (SELECT a.page, a.y * 100 + a.x0 AS a, b.y * 100 + b.x0 AS b FROM r a JOIN r b ON a.page = b.page AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
w AS (SELECT page, a, a AS b FROM e UNION SELECT w.page, w.a, e.b FROM w JOIN e ON w.page = e.page AND w.b = e.a),
l AS (SELECT page, a, min(b) AS label FROM w GROUP BY ALL),
g AS (SELECT r.page, coalesce(label, y * 100 + x0) AS label, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, sum(n) AS n, sum(total) AS total FROM r LEFT JOIN l ON r.page = l.page AND y * 100 + x0 = a GROUP BY ALL)
SELECT page, x0, y0, x1, y1, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS area, CAST(n AS BIGINT) AS n, round(total / n, 6) AS confidence FROM g WHERE (x1 - x0 + 1) * (y1 - y0 + 1) >= 6""")
def mask_regions(spark, sf_dir):
    """Connected regions of the pages' masks, from runs of pixels."""
    found = masks.regions(masks.runs(_mask_rows(spark, sf_dir), ["page"]), ["page"], 6)
    return found.select("page", "x0", "y0", "x1", "y1", "area", "n", F.round("confidence", 6).alias("confidence"))


@query("""WITH c AS (SELECT o_orderkey AS id, substring('Wml1', CAST(o_orderkey % 4 AS INT) + 1, 1) AS ch, (o_orderkey % 7) * 10 AS w FROM orders), r AS (SELECT l_orderkey AS id, l_linenumber AS k, max(CAST(l_quantity AS INT) % 9) AS ink FROM lineitem GROUP BY ALL),
t AS (SELECT c.*, CASE WHEN ch IN ('l', '1') THEN 1.0 ELSE least(greatest(2.0, w * 0.1), 5.0) END AS least FROM c), m AS (SELECT id, min(k) AS a, max(k) AS b FROM t JOIN r USING (id) WHERE ink >= least AND w > 0 AND k <= 7 GROUP BY id)
SELECT id, coalesce(99.0 + a, 100.0) AS y0, coalesce(100.0 + b, 107.0) AS y1 FROM t LEFT JOIN m USING (id)""")
def density_crop(spark, sf_dir):
    """Characters cut to the rows that have enough ink; a row's ink is that of the order's line of that number."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int") % 9).alias("k"))
    ink = per.groupBy(F.col("l_orderkey").alias("id")).agg(*(F.max(F.when(F.col("l_linenumber") == n, F.col("k"))).alias(f"k{n}") for n in range(1, 8)))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring(F.lit("Wml1"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)).alias("ch"), ((F.col("o_orderkey") % 7) * 10).alias("w")).join(ink, "id", "left")
    sums = F.array(*(F.coalesce(F.col(f"k{n}"), F.lit(-1)).cast("double") for n in range(1, 8)))
    cut = masks.density_crop(g.box(F.lit(0), F.lit(100), F.col("w"), F.lit(107)), sums, F.col("ch"))
    return o.select("id", cut.alias("b")).select("id", F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1"))


# ---- the line of a text line's glyphs


@query(f"""WITH p AS (SELECT vec_id // 20 AS g, CAST(vec_id % 20 AS DOUBLE) AS x, embedding[1]::DOUBLE AS y FROM embeddings), l AS (SELECT g, list({{'x': x, 'y': y}} ORDER BY x, y) AS p, count(*) AS n FROM p GROUP BY g HAVING count(*) > 1),
t AS (SELECT g, p, n, h, (h * {ransac.STEPS[0]} + {ransac.SEED}) % n AS i FROM l, (SELECT unnest(range({ransac.TRIALS})) AS h)), u AS (SELECT *, (i + 1 + (h * {ransac.STEPS[1]} + {ransac.SEED}) % (n - 1)) % n AS j FROM t),
m AS (SELECT g, p, n, h, (p[j + 1].y - p[i + 1].y) / (p[j + 1].x - p[i + 1].x) AS s, p[i + 1].y - (p[j + 1].y - p[i + 1].y) / (p[j + 1].x - p[i + 1].x) * p[i + 1].x AS c FROM u WHERE p[i + 1].x <> p[j + 1].x),
k AS (SELECT m.*, list_filter(p, lambda q: abs(q.y - (s * q.x + c)) <= 0.02) AS near FROM m),
b AS (SELECT g, n, arg_min(near, (-len(near), round(list_sum(list_transform(near, lambda q: pow(q.y - (s * q.x + c), 2))), 12), h)) AS near FROM k GROUP BY g, n),
f AS (SELECT g, n, len(near) AS inliers, unnest(near) AS q FROM b)
SELECT g, n, inliers, round(CASE WHEN count(DISTINCT q.x) > 1 THEN regr_slope(q.y, q.x) END, 5) AS slope FROM f GROUP BY g, n, inliers""")
def ransac_baseline(spark, sf_dir):
    """Lines through the points that agree, by a bounded number of hypotheses; the median of all pairs' slopes is "theil_sen_baseline"."""
    p = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("g"), (F.col("vec_id") % 20).cast("double").alias("x"), F.col("embedding")[0].cast("double").alias("y"), F.lit(0.02).alias("t"))
    return ransac.ransac_lines(p, ["g"], "t").select("g", "n", "inliers", F.round("slope", 5).alias("slope"))


# ---- domains by a table of suffixes: segments and nations make hosts, rules are a dimension

_RULES = ["com", "example", "my", "com.my", "*.jp", "!city.jp", "building", "uk", "co.uk"]


@query("""WITH h AS (SELECT c_custkey, 'www.' || lower(c_mktsegment) || CAST(c_custkey % 5 AS VARCHAR) || CASE c_custkey % 7 WHEN 0 THEN '.com' WHEN 1 THEN '.com.my' WHEN 2 THEN '.my' WHEN 3 THEN '.tokyo.jp' WHEN 4 THEN '.city.jp' WHEN 5 THEN '.co.uk' ELSE '.zz' END AS host FROM customer),
s AS (SELECT c_custkey, host, CASE c_custkey % 7 WHEN 0 THEN 'com' WHEN 1 THEN 'com.my' WHEN 2 THEN 'my' WHEN 3 THEN 'tokyo.jp' WHEN 4 THEN 'jp' WHEN 5 THEN 'co.uk' END AS suffix FROM h)
SELECT c_custkey, suffix, CASE c_custkey % 7 WHEN 4 THEN 'city.jp' WHEN 6 THEN NULL ELSE substring(host, 5) END AS domain FROM s""")
def registrable_domains(spark, sf_dir):
    """The longest suffix rule that holds, with wildcards and exceptions, and one label more."""
    k = F.col("c_custkey")
    ends = F.array(*map(F.lit, [".com", ".com.my", ".my", ".tokyo.jp", ".city.jp", ".co.uk", ".zz"]))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://WWW."), F.col("c_mktsegment"), (k % 5).cast("string"), F.element_at(ends, (k % 7 + 1).cast("int")), F.lit("/a?b=c.d")).alias("url"))
    rules = domains.suffix_rules(spark.createDataFrame([(r,) for r in _RULES], "rule string"))
    return domains.registrable(c, "url", rules).select("c_custkey", "suffix", "domain")


# ---- schema errors and nested lists of identifiers

_ORDER = {"type": "object", "fields": {
    "id": {"type": "integer", "least": 1}, "status": {"type": "string", "enum": ["F", "O"]}, "lines": {"type": "array", "items": {"type": "object", "fields": {"n": {"type": "integer", "most": 6}, "mode": {"type": "string", "required": False}}}},
}}


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem)
SELECT k, 'lines.' || i || '.n' AS path, 'range' AS kind FROM l WHERE n > 6 AND k % 4 > 0
UNION ALL SELECT k, 'lines.' || i || '.mode', 'type' FROM l WHERE n = 2 AND k % 4 > 0
UNION ALL SELECT o_orderkey, 'status', 'enum' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 4 > 0
UNION ALL SELECT o_orderkey, 'id', 'missing' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 4 > 0
UNION ALL SELECT o_orderkey, '', 'type' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'lines', 'missing' FROM orders LEFT JOIN (SELECT DISTINCT k FROM l) ON k = o_orderkey WHERE k IS NULL AND o_orderkey % 4 > 0""")
def schema_errors(spark, sf_dir):
    """All errors of each order's JSON, with their paths."""
    line = F.struct(F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    mode = lambda x: F.when(x["n"] == 2, "7").otherwise('"AIR"')
    lines = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.concat(F.lit('{"n": '), x["n"].cast("string"), F.lit(', "mode": '), mode(x), F.lit("}"))), ", "), F.lit("]"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus").join(li, "k", "left")
    own = F.concat(F.lit("{"), F.when(F.col("k") % 5 > 0, F.concat(F.lit('"id": '), F.col("k").cast("string"), F.lit(", "))).otherwise(""), F.lit('"status": "'), F.col("o_orderstatus"), F.lit('"'), F.when(F.col("l").isNotNull(), F.concat(F.lit(', "lines": '), lines)).otherwise(""), F.lit("}"))
    text = o.select("k", F.when(F.col("k") % 4 > 0, own).otherwise(F.lit("[1, {")).alias("text"))
    e = text.select("k", F.explode(schemas.schema_errors(F.try_parse_json("text"), _ORDER)).alias("e"))
    return e.select("k", "e.path", "e.kind")


@query("""WITH l AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(CAST(l_linenumber AS INT)))) AS ids FROM lineitem GROUP BY 1),
r AS (SELECT k, unnest(ids) AS id FROM l), i AS (SELECT k, id, id - row_number() OVER (PARTITION BY k ORDER BY id) AS island FROM r), s AS (SELECT k, min(id) AS a, max(id) AS b FROM i GROUP BY k, island),
t AS (SELECT k, string_agg(CASE WHEN a = b THEN '' || a ELSE a || '-' || b END, ',' ORDER BY a) AS t FROM s GROUP BY k) SELECT k, t AS outer_ids, t AS inner_ids, len(ids) AS n_other FROM t JOIN l USING (k)""")
def nested_ranges(spark, sf_dir):
    """Lists of identifiers at two depths, in lists of structs, as ranges; a list of another name stays."""
    ids = F.collect_list(F.col("l_linenumber").cast("int"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(ids.alias("i"))
    v = li.select("k", F.struct(F.col("i").alias("observation_ids"), F.array(F.struct(F.col("i").alias("observation_ids"), F.array_distinct("i").alias("other"))).alias("parts")).alias("v"))
    out = v.select("k", schemas.compress_nested(F.col("v"), v.schema["v"].dataType).alias("v"))
    part = F.col("v.parts")[0]
    return out.select("k", F.array_join("v.observation_ids", ",").alias("outer_ids"), F.array_join(part["observation_ids"], ",").alias("inner_ids"), F.size(part["other"]).cast("long").alias("n_other"))
