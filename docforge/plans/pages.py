"""Boxes, gaps, sessions, chunks and reading order. Boxes are made of line items: two an order line, on pages of 50 orders' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import components, joins, layout
from .base import query, table

_X = "(l_partkey * 7 + l_suppkey * 3) % 500"
_Y = "(l_partkey * 13 + l_linenumber * 29) % 700"
_W = "10 + l_quantity * 2"
_H = "8 + l_linenumber * 4"
BOXES = f"""b AS (SELECT l_orderkey // 50 AS page, row_number() OVER (PARTITION BY l_orderkey // 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS id, ({_X})::DOUBLE AS x0, ({_Y})::DOUBLE AS y0, ({_X} + {_W})::DOUBLE AS x1, ({_Y} + {_H})::DOUBLE AS y1 FROM lineitem)"""


def boxes(spark, sf_dir):
    li = layout.numbered(table(spark, sf_dir, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 50)), ["page"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"], "item_id")
    x, y, w, h = (F.expr(e) for e in (_X, _Y, _W, _H))
    return li.select("page", "item_id", g.box(x, y, x + w, y + h).alias("box"))


_INTER = "greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0)"
_AREA_A, _AREA_C = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((c.x1 - c.x0) * (c.y1 - c.y0))"
_IOU = f"({_INTER}) / ({_AREA_A} + {_AREA_C} - ({_INTER}))"
_IN = "((a.x0 + a.x1) / 2 BETWEEN c.x0 AND c.x1 AND (a.y0 + a.y1) / 2 BETWEEN c.y0 AND c.y1)"


@query(f"WITH {BOXES} SELECT a.page, a.id AS first, c.id AS second, round({_IOU}, 6) AS iou FROM b a JOIN b c ON a.page = c.page AND a.id < c.id AND {_IOU} >= 0.3")
def spatial_iou(spark, sf_dir):
    b = boxes(spark, sf_dir)
    other = b.select("page", F.col("item_id").alias("other_id"), F.col("box").alias("other"))
    iou = g.iou(F.col("box"), F.col("other"))
    pairs = joins.box_pairs(b, other, ["page"], (F.col("item_id") < F.col("other_id")) & (iou >= 0.3))
    return pairs.select("page", F.col("item_id").alias("first"), F.col("other_id").alias("second"), F.round(iou, 6).alias("iou"))


@query(f"WITH {BOXES} SELECT a.page, a.id AS first, c.id AS second FROM b a JOIN b c ON a.page = c.page AND a.id < c.id AND ({_INTER}) / least({_AREA_A}, {_AREA_C}) > 0.5")
def overlap_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    other = b.select("page", F.col("item_id").alias("other_id"), F.col("box").alias("other"))
    pairs = joins.box_pairs(b, other, ["page"], (F.col("item_id") < F.col("other_id")) & (g.overlap_of_smaller(F.col("box"), F.col("other")) > 0.5))
    return pairs.select("page", F.col("item_id").alias("first"), F.col("other_id").alias("second"))


def _split(spark, sf_dir):
    b = boxes(spark, sf_dir)
    regions = b.filter("item_id % 3 = 0").select("page", F.col("item_id").alias("region_id"), F.col("item_id").alias("ord"), F.col("box").alias("other"))
    return b.filter("item_id % 3 <> 0"), regions


@query(f"""WITH {BOXES}, i AS (SELECT * FROM b WHERE id % 3 <> 0), r AS (SELECT * FROM b WHERE id % 3 = 0),
m AS (SELECT a.page, a.id, arg_min(c.id, ({_AREA_C}, c.id)) AS region_id FROM i a JOIN r c ON a.page = c.page AND ({_IN} OR {_IOU} >= 0.3) GROUP BY ALL)
SELECT i.page, i.id AS item_id, m.region_id FROM i LEFT JOIN m USING (page, id)""")
def region_assign(spark, sf_dir):
    items, regions = _split(spark, sf_dir)
    return joins.assign_smallest(items, regions, ["page"])


@query(f"""WITH {BOXES}, i AS (SELECT * FROM b WHERE id % 3 <> 0), r AS (SELECT * FROM b WHERE id % 3 = 0)
SELECT a.page, a.id AS item_id, arg_max(c.id, ({_IOU}, -c.id)) AS cell_id, round(max({_IOU}), 6) AS iou FROM i a JOIN r c ON a.page = c.page AND {_IOU} >= 0.1 GROUP BY ALL""")
def best_iou_assign(spark, sf_dir):
    items, regions = _split(spark, sf_dir)
    return joins.assign_best_iou(items, regions.withColumnRenamed("region_id", "cell_id"), ["page"]).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {BOXES}, i AS (SELECT * FROM b WHERE id % 3 <> 0), r AS (SELECT * FROM b WHERE id % 3 = 0),
m AS (SELECT a.page, a.id, arg_min(c.id, (NOT {_IN}, CASE WHEN {_IN} THEN 0 ELSE -({_IOU}) END, c.id)) AS t FROM i a JOIN r c ON a.page = c.page AND ({_IN} OR {_IOU} >= 0.5) GROUP BY ALL)
SELECT i.page, i.id AS item_id, m.t AS target_id FROM i LEFT JOIN m USING (page, id)""")
def span_to_observation(spark, sf_dir):
    items, regions = _split(spark, sf_dir)
    return joins.center_then_iou(items, regions.withColumnRenamed("region_id", "target_id"), ["page"])


@query(f"""WITH {BOXES}, i AS (SELECT * FROM b WHERE id % 3 <> 0), r AS (SELECT * FROM b WHERE id % 3 = 0), k AS (SELECT DISTINCT a.page, a.id FROM i a JOIN r c ON a.page = c.page AND ({_INTER}) / {_AREA_A} >= 0.85)
SELECT page, id AS item_id, (page, id) IN (SELECT (page, id) FROM k) AS suppressed FROM i""")
def suppressed_regions(spark, sf_dir):
    items, regions = _split(spark, sf_dir)
    inside, outside = joins.covered(items, regions, ["page"], 0.85)
    return inside.select("page", "item_id", F.lit(True).alias("suppressed")).unionByName(outside.select("page", "item_id", F.lit(False).alias("suppressed")))


@query(f"""WITH RECURSIVE {BOXES}, i AS (SELECT * FROM b WHERE id % 3 <> 0), r AS (SELECT * FROM b WHERE id % 3 = 0), p AS (SELECT a.page, a.id AS l, c.id AS r, {_IOU} AS iou FROM i a JOIN r c ON a.page = c.page AND {_IOU} >= 0.3),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, l, r) AS k FROM p), q AS (SELECT page, list(struct_pack(l := l, r := r) ORDER BY k) AS q FROM n GROUP BY page),
w AS (SELECT page, q, [q[1]] AS done, 2 AS k FROM q UNION ALL SELECT page, q, CASE WHEN len(list_filter(done, lambda d: d.l = q[k].l OR d.r = q[k].r)) > 0 THEN done ELSE list_append(done, q[k]) END, k + 1 FROM w WHERE k <= len(q)),
m AS (SELECT page, unnest(done) AS d FROM w WHERE k > len(q)), t AS (SELECT page, d.l AS l, d.r AS r FROM m)
SELECT i.page, i.id AS item_id, t.r AS other_id FROM i LEFT JOIN t ON i.page = t.page AND i.id = t.l UNION ALL SELECT r.page, NULL, r.id FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = r.page AND t.r = r.id)""")
def matched_tables(spark, sf_dir):
    items, regions = _split(spark, sf_dir)
    right = regions.select("page", F.col("region_id").alias("item_id"), F.col("other").alias("box"))
    return joins.greedy_pairs(items, right, ["page"], 0.3).select("page", "item_id", "other_id")


@query(f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.page, a.id AS x, c.id AS y FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id AND {_IOU} >= 0.3),
w AS (SELECT page, x, x AS y FROM e UNION SELECT w.page, w.x, e.y FROM w JOIN e ON w.page = e.page AND w.y = e.x),
l AS (SELECT page, x, min(y) AS label FROM w GROUP BY ALL) SELECT page, label AS first, count(*) AS n FROM l GROUP BY ALL""")
def consensus_clusters(spark, sf_dir):
    pairs = spatial_iou(spark, sf_dir).select(F.struct("page", F.col("first").alias("id")).alias("a"), F.struct("page", F.col("second").alias("id")).alias("b"))
    labels = components.connected(pairs)
    return labels.groupBy(F.col("label.page").alias("page"), F.col("label.id").alias("first")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS a, epoch_us(ts) / 1000000.0 + value * 60 AS b FROM events), s AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i)
SELECT user_id, round(m, 3) AS gap_start, round(a, 3) AS gap_end FROM s WHERE a - m >= 3600""")
def gap_sweep(spark, sf_dir):
    t = F.col("ts").cast("timestamp").cast("double")
    i = table(spark, sf_dir, "events").select("user_id", t.alias("a"), (t + F.col("value") * 60).alias("b"))
    return layout.gaps(i, ["user_id"], "a", "b", 3600.0).select("user_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))


@query("""WITH i AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS a, epoch_us(ts) / 1000000.0 + value AS b FROM events), s AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
n AS (SELECT *, sum(CASE WHEN m IS NULL OR a - m > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) - 1 AS session FROM s)
SELECT user_id, session, count(*) AS n, min(event_id) AS first FROM n GROUP BY ALL""")
def y_sessionise(spark, sf_dir):
    t = F.col("ts").cast("timestamp").cast("double")
    i = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("a"), (t + F.col("value")).alias("b"))
    out = layout.sessions(i, ["user_id"], "a", "b", F.lit(36000.0), ["a", "event_id"])
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"""WITH {BOXES}, e AS (SELECT page, x0 AS at, 1 AS d FROM b UNION ALL SELECT page, x1, -1 FROM b), s AS (SELECT page, at, sum(d) AS d FROM e GROUP BY ALL), p AS (SELECT page, sum(d) OVER (PARTITION BY page ORDER BY at) AS depth, lead(at) OVER (PARTITION BY page ORDER BY at) AS until FROM s)
SELECT page, max(depth) AS most, count(*) AS n FROM p WHERE until IS NOT NULL GROUP BY page""".replace(" AS at,", ' AS "at",').replace("page, at,", 'page, "at",').replace("ORDER BY at", 'ORDER BY "at"').replace("lead(at)", 'lead("at")').replace("GROUP BY ALL), p", 'GROUP BY page, "at"), p'))
def depth_profile(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"))
    return layout.depth_profile(b, ["page"], "x0", "x1").groupBy("page").agg(F.max("depth").alias("most"), F.count("*").alias("n"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS chunk, turn FROM conversations")
def page_chunks(spark, sf_dir):
    return layout.chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 2).select("conv_id", "chunk", "turn")


_FULL = "w.n >= 3 OR w.chars + c.c > 1500"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id AS k, turn AS o, coalesce(length(text), 0) + 100 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT k, o, i, 0 AS chunk, 1 AS n, c AS chars FROM c WHERE i = 1 UNION ALL
  SELECT c.k, c.o, c.i, CASE WHEN {_FULL} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN {_FULL} THEN 1 ELSE w.n + 1 END, CASE WHEN {_FULL} THEN c.c ELSE w.chars + c.c END FROM w JOIN c ON c.k = w.k AND c.i = w.i + 1)
SELECT k, chunk, min(o) AS first, max(o) AS last, count(*) AS n FROM w GROUP BY k, chunk""")
def budget_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("o"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return layout.budget_chunks(c, ["k"], "o", F.col("chars"), most=3, most_chars=1500)


@query("""WITH d AS (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY 1) SELECT h, a AS first, b AS second FROM d WHERE n = 2""")
def reuse_pairs(spark, sf_dir):
    side = F.struct(*(v.cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (F.col("doc_id") * 100, F.lit(0), F.col("doc_id") * 100 + 10, F.lit(10)))))
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("page"), F.md5("text").alias("h"), F.col("doc_id").alias("object_id"), side.alias("box"))
    return layout.reused(d, ["page"], "h").select("h", "first", "second")


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS row, l_returnflag || '.' || l_linestatus AS text, l_suppkey % 3 AS col FROM lineitem), u AS (SELECT k, row, col, min(text) AS text FROM c GROUP BY ALL), r AS (SELECT k, row, string_agg(text, ' | ' ORDER BY col) AS line FROM u GROUP BY ALL)
SELECT k, string_agg(line, chr(10) ORDER BY row) AS text FROM r GROUP BY k""")
def table_text(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 3).alias("col"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("text"))
    return layout.table_text(c.groupBy("k", "row", "col").agg(F.min("text").alias("text")), ["k"])


@query(f"""WITH {BOXES}, p AS (SELECT page // 20 AS doc, page % 20 AS page, id, x0, y0 FROM b), e AS (SELECT doc, page, x0, y0, row_number() OVER (PARTITION BY doc ORDER BY page, y0, x0, id) AS rank FROM p WHERE id % 5 <> 1), o AS (SELECT doc, page, y0, page * 1000000 + id AS oid FROM p WHERE id % 5 = 1),
x AS (SELECT doc, page, y0, min(rank) AS rank FROM e GROUP BY ALL),
m AS (SELECT o.doc, o.page, o.y0, o.oid, (SELECT min(x.rank) FROM x WHERE x.doc = o.doc AND (x.page > o.page OR (x.page = o.page AND x.y0 > o.y0))) AS anchor FROM o),
u AS (SELECT doc, NULL::BIGINT AS oid, page, y0, rank::DOUBLE AS k, 1 AS kind FROM e UNION ALL SELECT doc, oid, page, y0, coalesce(anchor::DOUBLE, 'inf'::DOUBLE), 0 FROM m)
SELECT doc, oid AS orphan_id, page, y0, row_number() OVER (PARTITION BY doc ORDER BY k, kind, page, y0, oid) - 1 AS reading_order_index FROM u""")
def reading_order(spark, sf_dir):
    """All boxes of a document of 20 pages: four fifths are elements, the others orphans that go before the next element below."""
    b = boxes(spark, sf_dir).select(F.floor(F.col("page") / 20).alias("doc"), (F.col("page") % 20).alias("page"), "item_id", F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"))
    e = layout.numbered(b.filter("item_id % 5 <> 1"), ["doc"], ["page", "y0", "x0", "item_id"], "rank", start=1)
    o = b.filter("item_id % 5 = 1").select("doc", "page", "y0", (F.col("page") * 1_000_000 + F.col("item_id")).alias("orphan_id"))
    return layout.reading_order(e.select("doc", "page", "y0", "rank"), o, ["doc"]).select("doc", "orphan_id", "page", "y0", "reading_order_index")
