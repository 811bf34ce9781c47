"""Robust statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import stats
from .base import query, table


def _r(c, n=6):
    return F.round(F.col(c).cast("decimal(28,10)"), n).cast("double").alias(c)


_BENFORD = ", ".join(f"abs(count(*) FILTER (d = '{d}') / count(d) - log10(1 + 1.0 / {d}))" for d in range(1, 10)).replace("), abs", ") + abs")


@query(f"""WITH v AS (SELECT 'price' AS src, l_returnflag AS k, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS s FROM lineitem UNION ALL SELECT 'event', event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) FROM events),
f AS (SELECT src, k, nullif(regexp_extract(s, '^[0.,\\-+ ]*([1-9])', 1), '') AS d FROM v),
b AS (SELECT src, k, count(d) AS n, ({_BENFORD}) / 9 AS mad FROM f GROUP BY ALL)
SELECT src, k, n, round(mad, 6) AS mad, CASE WHEN mad < 0.006 THEN 'close' WHEN mad < 0.012 THEN 'acceptable' ELSE 'failed' END AS zone FROM b WHERE n >= 30""")
def benford_by_status(spark, sf_dir):
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    a = table(spark, sf_dir, "lineitem").select(F.lit("price").alias("src"), F.col("l_returnflag").alias("k"), text("l_extendedprice").alias("s"))
    b = table(spark, sf_dir, "events").select(F.lit("event").alias("src"), F.col("event_type").alias("k"), text("value").alias("s"))
    rows = a.unionByName(b).withColumn("d", values.first_digit(F.col("s")))
    return stats.benford(rows, ["src", "k"], "d").select("src", "k", "n", F.round("mad", 6).alias("mad"), "zone")


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.*, med, abs(value - med) AS dev FROM events e JOIN m USING (event_type)), k AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1)
SELECT event_id, event_type, round(med, 6) AS median, round(mad, 6) AS mad, round(0.6745 * dev / greatest(mad, 0.5), 6) AS z FROM d JOIN k USING (event_type) WHERE 0.6745 * dev / greatest(mad, 0.5) > 1.2""")
def modified_z(spark, sf_dir):
    out = stats.with_mad(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.filter("z > 1.2").select("event_id", "event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("z", 6).alias("z"))


@query("""WITH l AS (SELECT l_partkey, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS v FROM lineitem), m AS (SELECT l_partkey, count(*) AS n, median(v) AS med, mad(v) AS mad FROM l GROUP BY 1 HAVING count(*) >= 11)
SELECT l_partkey, n, round(med, 4) AS median, round(mad, 4) AS mad FROM m""")
def mad_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("double").alias("v"))
    return stats.medians(rows, ["l_partkey"], "v").filter("n >= 11").select("l_partkey", "n", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("""WITH l AS (SELECT l_partkey, CAST(l_quantity AS DOUBLE) AS q, median(l_quantity) OVER (PARTITION BY l_partkey) AS med, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
d AS (SELECT *, median(abs(q - med)) OVER (PARTITION BY l_partkey) AS mad FROM l WHERE n >= 11)
SELECT l_partkey, count(*) AS n, count(*) FILTER (0.6745 * abs(q - med) / greatest(mad, 0.5) > 2.0 AND abs(q - med) > 0.15) AS outliers FROM d GROUP BY 1""")
def robust_outliers(spark, sf_dir):
    z = stats.with_mad(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", least=11)
    hit = (F.col("z") > 2.0) & (F.abs(F.col("l_quantity") - F.col("median")) > 0.15)
    return z.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(hit).alias("outliers"))


@query("""WITH g AS (SELECT c_nationkey % 25 AS k, c_mktsegment AS s, c_custkey // 400 AS b, list_sort(list(c_acctbal)) AS v, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) BETWEEN 3 AND 10),
q AS (SELECT *, CASE WHEN n >= 8 THEN v[n - 1] ELSE v[n] END - v[1] AS lo, v[n] - CASE WHEN n >= 8 THEN v[2] ELSE v[1] END AS hi, CASE n WHEN 3 THEN 0.970 WHEN 4 THEN 0.829 WHEN 5 THEN 0.710 WHEN 6 THEN 0.628 WHEN 7 THEN 0.569 WHEN 8 THEN 0.608 WHEN 9 THEN 0.564 ELSE 0.530 END AS crit FROM g)
SELECT k, s, b, n, CASE WHEN lo = 0 THEN 0 ELSE (v[2] - v[1]) / lo END > crit AS low_is_outlier, CASE WHEN hi = 0 THEN 0 ELSE (v[n] - v[n - 1]) / hi END > crit AS high_is_outlier FROM q""")
def dixon_small_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 25).alias("k"), F.col("c_mktsegment").alias("s"), F.floor(F.col("c_custkey") / 400).alias("b"), "c_acctbal")
    return stats.dixon(c, ["k", "s", "b"], "c_acctbal").select("k", "s", "b", "n", "low_is_outlier", "high_is_outlier")


@query("""SELECT l_partkey % 300 AS k, l_linenumber AS ln, count(*) AS n, (count(*) >= 5 AND stddev_pop(v) / avg(v) < 0.01) AS tabular FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 7.25 ELSE l_quantity END AS v FROM lineitem) GROUP BY ALL""")
def tabular_switch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("k"), F.col("l_linenumber").alias("ln"), F.when(F.col("l_partkey") % 3 == 0, F.lit(7.25)).otherwise(F.col("l_quantity")).alias("v"))
    return stats.tabular_groups(li, ["k", "ln"], "v").select("k", "ln", "n", "tabular")


@query("""WITH b AS (SELECT lang, source, sum(n_chars) AS n FROM documents GROUP BY ALL), g AS (SELECT *, ln(n) AS l, count(*) OVER (PARTITION BY lang) AS k, sum(n) OVER (PARTITION BY lang) AS t FROM b WHERE n >= 2),
m AS (SELECT *, median(l) OVER (PARTITION BY lang) AS med FROM g WHERE k >= 3 AND t >= 30), d AS (SELECT *, median(abs(l - med)) OVER (PARTITION BY lang) AS mad FROM m)
SELECT lang, source, n, l < med - 1.5 * greatest(mad, 0.1) / 0.6745 AS rare FROM d""")
def rare_bars_log_mad(spark, sf_dir):
    bars = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n_chars"))
    return stats.rare_bars(bars, ["lang"], "n_chars", k=1.5).select("lang", "source", F.col("n_chars").alias("n"), "rare")


@query("""WITH h AS (SELECT lang, source, sum(n_chars) AS w FROM documents GROUP BY ALL) SELECT lang, source, w AS weight, round(w / sum(w) OVER (PARTITION BY lang), 6) AS share FROM h""")
def style_distribution(spark, sf_dir):
    out = stats.histogram(table(spark, sf_dir, "documents"), ["lang"], "source", F.col("n_chars"))
    return out.select("lang", "source", "weight", F.round("share", 6).alias("share"))


@query("""WITH h AS (SELECT lang, source, sum(n_chars) AS w, min(doc_id) AS o FROM documents GROUP BY ALL) SELECT lang, arg_max(source, (w, -o)) AS source, max(w) AS weight FROM h GROUP BY lang""")
def dominant_key(spark, sf_dir):
    return stats.dominant(table(spark, sf_dir, "documents"), ["lang"], "source", F.col("n_chars"), "doc_id")


@query("""WITH s AS (SELECT doc_id, n_chars, 'global' AS scope, 'all' AS scope_id FROM documents UNION ALL SELECT doc_id, n_chars, 'lang', lang FROM documents UNION ALL SELECT doc_id, n_chars, 'source', source FROM documents),
m AS (SELECT *, median(n_chars) OVER (PARTITION BY scope, scope_id) AS med, count(*) OVER (PARTITION BY scope, scope_id) AS k FROM s), d AS (SELECT *, median(abs(n_chars - med)) OVER (PARTITION BY scope, scope_id) AS mad FROM m WHERE k >= 5),
h AS (SELECT doc_id, scope FROM d WHERE 0.6745 * abs(n_chars - med) / greatest(mad, 0.5) > 3.5)
SELECT doc_id, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes, least(1.0, 0.7 + 0.15 * (count(DISTINCT scope) - 1)) AS confidence FROM h GROUP BY doc_id""")
def scope_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    long = stats.scoped(d, {"global": F.lit("all"), "lang": F.col("lang"), "source": F.col("source")})
    hits = stats.with_mad(long, ["scope", "scope_id"], "n_chars", least=5).filter("z > 3.5")
    return stats.merge_scopes(hits, ["doc_id"]).select("doc_id", F.array_join("scopes", ",").alias("scopes"), F.round("confidence", 2).alias("confidence"))


@query("""WITH x AS (SELECT label, unnest([1, 2, 3]) AS i, unnest([embedding[1], embedding[2], embedding[3]]) AS v FROM embeddings), m AS (SELECT *, median(v::DOUBLE) OVER (PARTITION BY label, i) AS med FROM x), a AS (SELECT label, i, median(abs(v - med)) AS mad FROM m GROUP BY ALL)
SELECT label, arg_min(['left', 'mid', 'right'][i], (mad, i)) AS axis, round(min(mad), 6) AS mad FROM a GROUP BY label""")
def column_alignment_axis(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[i].alias(n) for i, n in enumerate(("left", "mid", "right"))))
    return stats.best_axis(e, ["label"], ["left", "mid", "right"]).select("label", "axis", F.round("mad", 6).alias("mad"))


@query("""WITH h AS (SELECT o_custkey AS t, o_orderkey % 4 AS row, o_orderkey % 7 AS col, o_orderkey FROM orders), n AS (SELECT *, len(list_distinct(list(col) OVER (PARTITION BY t, row))) AS k FROM h)
SELECT t, row, col, o_orderkey FROM n WHERE NOT (row <= 1 AND k >= 2)""")
def header_forgiveness(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), (F.col("o_orderkey") % 4).alias("row"), (F.col("o_orderkey") % 7).alias("col"), "o_orderkey")
    return stats.forgive_headers(h, ["t"], "row", "col")


@query("""WITH p AS (SELECT vec_id // 20 AS g, CAST(vec_id % 20 AS DOUBLE) AS x, embedding[1]::DOUBLE AS y FROM embeddings), s AS (SELECT a.g, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.g = b.g AND a.x < b.x GROUP BY a.g)
SELECT g, round(any_value(slope), 6) AS slope, round(median(y - slope * x), 6) AS intercept, count(*) AS n FROM p JOIN s USING (g) GROUP BY g""")
def theil_sen_baseline(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("g"), (F.col("vec_id") % 20).cast("double").alias("x"), F.col("embedding")[0].cast("double").alias("y"))
    return stats.robust_line(p, ["g"]).select("g", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query("""WITH n AS (SELECT lang, source, sum(n_chars) AS n, list_sort(list_distinct(list(doc_id % 9))) AS p FROM documents GROUP BY ALL)
SELECT lang, source, CAST(n AS BIGINT) AS n_chars, round(n * 100.0 / sum(n) OVER (PARTITION BY lang), 2) AS coverage, array_to_string(p, ',') AS pages, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS place FROM n""")
def font_coverage(spark, sf_dir):
    """Percentages by font with the pages that have it, fullest first: sources stand for fonts, languages for documents."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "n_chars", (F.col("doc_id") % 9).alias("page"))
    return stats.coverage(d, ["lang"], "source", "n_chars", "page").withColumn("pages", F.array_join("pages", ","))


@query("""WITH b AS (SELECT event_type AS k, CAST(floor(value / 10) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY k) AS top, arg_min(bin, (-n, bin)) OVER (PARTITION BY k) AS peak FROM b),
h AS (SELECT *, bin - row_number() OVER (PARTITION BY k ORDER BY bin) AS island FROM t WHERE n * 2 >= top)
SELECT k, count(*) AS width FROM h GROUP BY k, island HAVING bool_or(bin = peak)""")
def half_max_width(spark, sf_dir):
    bins = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return stats.half_width(bins, ["k"])


# ---- reports of a document's rarest and most frequent things


@query("""WITH n AS (SELECT lang AS d, source, n_chars % 7 AS size, count(*) AS n_spans, sum(n_chars) AS n_chars FROM documents GROUP BY ALL), t AS (SELECT *, n_chars / sum(n_chars) OVER (PARTITION BY d) AS share FROM n)
SELECT d, source, size, n_spans, CAST(n_chars AS BIGINT) AS n_chars, round(share, 6) AS share, share < 0.02 OR n_chars < 30 AS rare, row_number() OVER (PARTITION BY d ORDER BY n_chars DESC, source, size) AS place FROM t""")
def rare_styles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("d"), "source", (F.col("n_chars") % 7).alias("size"), "n_chars")
    return stats.rare_styles(d, ["d"], ["source", "size"], "n_chars").withColumn("share", F.round("share", 6))


@query("""WITH s AS (SELECT user_id AS d, event_type AS style, event_id % 13 AS flag, props AS text, event_id AS o FROM events), n AS (SELECT d, style, flag, sum(length(text)) AS n_chars FROM s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n_chars, style, flag) AS bin FROM n QUALIFY bin <= 10)
SELECT d, style, flag, CAST(n_chars AS BIGINT) AS n_chars, bin, row_number() OVER (PARTITION BY d, bin ORDER BY length(text), o) AS item, o, text FROM s JOIN b USING (d, style, flag) QUALIFY item <= 10""")
def rarest_spans(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("d"), F.col("event_type").alias("style"), (F.col("event_id") % 13).alias("flag"), F.col("props").alias("text"), F.col("event_id").alias("o"))
    return stats.rarest(s, ["d"], ["style", "flag"], "text", "o")


@query("""WITH n AS (SELECT l_suppkey AS d, CAST(l_quantity AS BIGINT) AS width, l_linenumber AS height, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, width, height) AS place FROM n QUALIFY place <= 10""")
def top_image_sizes(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("d"), F.col("l_quantity").cast("long").alias("width"), F.col("l_linenumber").alias("height"))
    return stats.top_sizes(i, ["d"])


@query("""WITH g AS (SELECT o_custkey % 50 AS d, o_orderdate AS h, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:10] AS m FROM orders GROUP BY ALL HAVING count(*) > 1)
SELECT d, n, array_to_string(m, ',') AS members, row_number() OVER (PARTITION BY d ORDER BY n DESC, h) AS place, n > 10 AS truncated FROM g QUALIFY place <= 20""")
def duplicate_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("d"), F.col("o_orderdate").alias("h"), "o_orderkey")
    return stats.duplicate_groups(o, ["d"], "h", "o_orderkey").select("d", F.col("n").cast("long").alias("n"), F.array_join("members", ",").alias("members"), "place", "truncated")


@query("""WITH l AS (SELECT lang AS d, doc_id, n_chars, doc_id % 9 + 1 AS spans, ln(1 + n_chars::DOUBLE / (doc_id % 9 + 1)) AS v FROM documents), m AS (SELECT *, median(v) OVER (PARTITION BY d) AS med FROM l), k AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY d) AS mad FROM m)
SELECT d, doc_id, spans >= 5 AND v < med AND 0.6745 * abs(v - med) / greatest(mad, 0.05) > 3.5 AS fragmented FROM k WHERE v IS NOT NULL""")
def span_fragmentation(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select(F.col("lang").alias("d"), "doc_id", "n_chars", (F.col("doc_id") % 9 + 1).alias("spans"))  # noqa: E741
    return stats.fragmentation(l, ["d"], "spans", "n_chars").select("d", "doc_id", "fragmented")
