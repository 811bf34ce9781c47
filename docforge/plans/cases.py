"""Evidence of failed checks, its case files, conflicts, and file metadata over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import evidence, metadata, validation
from ..operators.results import split_results
from .base import query, table
from .ledgers import CHECKED, bank_rows

_EV = """ev AS (SELECT doc_id, row_idx AS ord, CASE WHEN row_idx % 3 = 0 THEN 'A' ELSE 'B' END AS type, (row_idx // 4)::VARCHAR AS value, CASE WHEN delta > 3 THEN 0.9 ELSE 0.7 END AS confidence, row_idx % 5 AS page FROM c WHERE state = 'failed')"""
_MERGED = f"""{CHECKED}, {_EV}, m AS (SELECT doc_id, type, value, min(ord) AS ord, max(confidence) AS confidence, arg_max(page, (confidence, -ord)) AS page FROM ev GROUP BY doc_id, type, value)"""


def _merged(spark, sf_dir):
    from ..operators.ledger import running_balance

    bad = running_balance(bank_rows(spark, sf_dir)).filter("state = 'failed'")
    rows = bad.select("doc_id", F.col("row_idx").alias("ord"), F.when(F.col("row_idx") % 3 == 0, "A").otherwise("B").alias("type"), F.floor(F.col("row_idx") / 4).cast("string").alias("value"), F.when(F.col("delta") > 3, F.lit(0.9)).otherwise(F.lit(0.7)).alias("confidence"), (F.col("row_idx") % 5).alias("page"))
    rows = rows.withColumn("fp", evidence.fingerprint("type", "value"))
    return evidence.merge_evidence(rows, ["doc_id"], "fp", "ord", "confidence")


@query(f"""{_MERGED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY type, page, ord) AS k FROM m), g AS (SELECT *, min(k) OVER (PARTITION BY doc_id, type, page) AS f FROM n)
SELECT doc_id, printf('E%03d', k) AS evidence_id, printf('G%03d', dense_rank() OVER (PARTITION BY doc_id ORDER BY f)) AS group_id, type, value, page, confidence, ord FROM g""")
def evidence_dedupe_index(spark, sf_dir):
    out = evidence.index_evidence(_merged(spark, sf_dir), ["doc_id"], ["type", "page", "ord"], ["type", "page"])
    return out.select("doc_id", "evidence_id", "group_id", "type", "value", "page", "confidence", "ord")


@query("""WITH c AS (SELECT c_mktsegment AS kind, c_nationkey AS t, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS total FROM customer)
SELECT kind, t, c_custkey, n, total, false AS is_summary FROM c WHERE n <= 5 UNION ALL SELECT kind, t, c_custkey, n, total, true FROM c WHERE n = 1 AND total > 5""")
def conflict_topk(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("t"), "c_custkey")
    return evidence.top_conflicts(c, ["kind", "t"], ["c_custkey"])


@query(f"""{CHECKED} SELECT 'failed' AS part, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE state = 'failed' UNION ALL SELECT 'incomplete', count(*), count(DISTINCT doc_id) FROM c WHERE state = 'incomplete'
UNION ALL SELECT 'counted', sum(n)::BIGINT, count(DISTINCT doc_id) FROM (SELECT doc_id, count(*) AS n FROM c WHERE state = 'passed' GROUP BY 1)""")
def casefile_split(spark, sf_dir):
    from ..operators.ledger import running_balance

    r = running_balance(bank_rows(spark, sf_dir)).select("doc_id", F.lit("bank.running_balance_recursion").alias("rule_name"), F.col("state").alias("status"))
    failed, incomplete, counted = split_results(r, ["doc_id"])
    part = lambda name, df, n: df.agg(n.cast("long").alias("n"), F.countDistinct("doc_id").alias("docs")).select(F.lit(name).alias("part"), "n", "docs")
    return part("failed", failed, F.count("*")).unionByName(part("incomplete", incomplete, F.count("*"))).unionByName(part("counted", counted, F.sum("n")))


@query(f"""{_MERGED}, x AS (SELECT doc_id, count(*) AS n_evidence, max(confidence) AS most FROM m GROUP BY 1), i AS (SELECT doc_id, count(*) AS n_incomplete FROM c WHERE state = 'incomplete' GROUP BY 1), p AS (SELECT doc_id, count(*) AS n_passed FROM c WHERE state = 'passed' GROUP BY 1)
SELECT doc_id, coalesce(n_evidence, 0) AS n_evidence, most, coalesce(n_incomplete, 0) AS n_incomplete, coalesce(n_passed, 0) AS n_passed FROM (SELECT DISTINCT user_id AS doc_id FROM events) LEFT JOIN x USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN p USING (doc_id)""")
def case_file(spark, sf_dir):
    from ..operators.ledger import running_balance

    indexed = evidence.index_evidence(_merged(spark, sf_dir), ["doc_id"], ["type", "page", "ord"], ["type", "page"])
    r = running_balance(bank_rows(spark, sf_dir)).select("doc_id", F.lit("bank.running_balance_recursion").alias("rule_name"), F.col("state").alias("status"), F.col("row_idx").alias("row_index"))
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    files = evidence.case_files(docs, indexed, r)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return files.select("doc_id", F.greatest(size("evidence"), F.lit(0)).alias("n_evidence"), F.array_max(F.transform("evidence", lambda e: e["confidence"])).alias("most"), F.greatest(size("incomplete"), F.lit(0)).alias("n_incomplete"), F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0)).alias("n_passed"))


_WIDE = """w AS (SELECT doc_id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 50 AS INTEGER)) AS created_at, TIMESTAMP '2024-01-02' - to_hours(CAST(doc_id % 30 AS INTEGER)) AS modified_at, doc_id % 7 AS revisions, ['Microsoft Word', 'Adobe Photoshop', 'Canva', 'LibreOffice'][doc_id % 4 + 1] AS producer,
  ['Writer', 'Microsoft Word', 'Adobe Acrobat'][doc_id % 3 + 1] AS creator, n_chars AS objects, n_chars // 2 + doc_id % 600 AS object_streams, (500 + doc_id % 400)::DOUBLE AS page_width, (400 + doc_id % 300)::DOUBLE AS page_height, doc_id % 9 AS n_fonts FROM documents)"""


@query(f"""WITH {_WIDE}
SELECT doc_id, 'TEMPORAL_INCONSISTENCY' AS type, 0.95 AS confidence FROM w WHERE modified_at < created_at
UNION ALL SELECT doc_id, 'INCREMENTAL_UPDATE', 0.92 FROM w WHERE revisions > 3 AND producer IN ('Adobe Photoshop', 'Canva')
UNION ALL SELECT doc_id, 'FONT_ANOMALY', 0.65 FROM w WHERE n_fonts > 6
UNION ALL SELECT doc_id, 'PAGE_DIMENSION', 0.85 FROM w WHERE page_width / page_height < 0.8 OR page_width / page_height > 2
UNION ALL SELECT doc_id, 'OBJECT_STREAM', 0.75 FROM w WHERE objects > 0 AND object_streams / objects::DOUBLE > 0.8
UNION ALL SELECT doc_id, 'OBJECT_GRAPH', 0.7 FROM w WHERE objects > 500
UNION ALL SELECT doc_id, 'XMP_TOOL_MISMATCH', 0.78 FROM w WHERE NOT contains(lower(creator), lower(producer)) AND NOT contains(lower(producer), lower(creator)) AND NOT (contains(lower(producer), 'word') AND contains(lower(creator), 'acrobat'))""")
def file_rules_one_scan(spark, sf_dir):
    k = F.col("doc_id")
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    w = table(spark, sf_dir, "documents").select(
        "doc_id", F.timestamp_add("HOUR", (k % 50).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"), F.timestamp_add("HOUR", (-(k % 30)).cast("int"), F.lit("2024-01-02").cast("timestamp")).alias("modified_at"), (k % 7).alias("revisions"),
        pick(4, ["Microsoft Word", "Adobe Photoshop", "Canva", "LibreOffice"]).alias("producer"), pick(3, ["Writer", "Microsoft Word", "Adobe Acrobat"]).alias("creator"), F.col("n_chars").alias("objects"),
        (F.floor(F.col("n_chars") / 2) + k % 600).alias("object_streams"), (500 + k % 400).cast("double").alias("page_width"), (400 + k % 300).cast("double").alias("page_height"),
        F.when(k % 9 > 0, F.transform(F.sequence(F.lit(1), (k % 9).cast("int")), lambda i: F.concat(F.lit("F"), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("fonts"))
    kinds = ["TEMPORAL_INCONSISTENCY", "INCREMENTAL_UPDATE", "FONT_ANOMALY", "PAGE_DIMENSION", "OBJECT_STREAM", "OBJECT_GRAPH", "XMP_TOOL_MISMATCH"]
    return metadata.evidence(w, kinds).select("doc_id", "type", "confidence")


@query("""WITH t AS (SELECT o_orderkey AS doc_id, unnest([o_orderdate::TIMESTAMP, o_orderdate::TIMESTAMP, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP - to_days(CAST(o_custkey % 5 AS INTEGER)) END]) AS at_time, unnest(['created', 'created', 'modified']) AS source FROM orders)
SELECT doc_id, at_time, source, row_number() OVER (PARTITION BY doc_id ORDER BY at_time, source) AS n FROM (SELECT DISTINCT * FROM t WHERE at_time IS NOT NULL)""")
def timeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("a"), F.col("o_orderdate").cast("timestamp").alias("b"), F.when(F.col("o_orderkey") % 2 == 0, F.timestamp_add("DAY", (-(F.col("o_custkey") % 5)).cast("int"), F.col("o_orderdate").cast("timestamp"))).alias("c"))
    return metadata.timeline(w, {"a": "created", "b": "created", "c": "modified"}).withColumnRenamed("at", "at_time")


@query("""WITH r AS (SELECT l_orderkey % 50 AS doc_id, 'ABC+' || strftime(l_shipdate, '%Y-%m') AS font, l_linenumber AS page FROM lineitem), u AS (SELECT DISTINCT l_orderkey % 50 AS doc_id, strftime(l_shipdate, '%Y-%m') AS font FROM lineitem WHERE l_quantity > 25)
SELECT doc_id, f AS font, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages FROM (SELECT doc_id, split_part(font, '+', 2) AS f, page FROM r) WHERE (doc_id, f) NOT IN (SELECT (doc_id, font) FROM u) GROUP BY ALL""")
def unused_fonts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    r = li.select((F.col("l_orderkey") % 50).alias("doc_id"), F.concat(F.lit("ABC+"), month).alias("font"), F.col("l_linenumber").alias("page"))
    u = li.filter("l_quantity > 25").select((F.col("l_orderkey") % 50).alias("doc_id"), month.alias("font"))
    return metadata.unused_fonts(r, u).select("doc_id", "font", F.array_join("pages", ",").alias("pages"))


@query("""WITH a AS (SELECT page_id % 40 AS page, regexp_replace(url, '[?#].*$', '') AS target, CASE WHEN page_id % 2 = 0 THEN 'x' ELSE 'y' END AS source FROM pages)
SELECT page, target, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM a GROUP BY ALL""")
def annotation_dedupe(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select(F.lit(0).alias("doc_id"), (F.col("page_id") % 40).alias("page"), F.lit("link").alias("kind"), F.regexp_replace("url", "[?#].*$", "").alias("target"), F.when(F.col("page_id") % 2 == 0, "x").otherwise("y").alias("source"))
    return metadata.annotations(a).select("page", "target", F.array_join("sources", ",").alias("sources"))


@query("""WITH f AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(18,2)) AS stated, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + 1 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS seen FROM orders)
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'missing_source' ELSE 'vlm_ocr_numeric_mismatch' END AS kind FROM f WHERE doc_id % 10 = 9 OR stated <> seen""")
def cross_validation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(18,6)")
    facts = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("ord"), F.lit("TOTAL_AMOUNT").alias("role"), price.alias("amount"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("string").alias("raw"), F.when(F.col("o_orderkey") % 10 != 9, F.array(F.lit(1001), F.lit(1002))).otherwise(F.array().cast("array<int>")).alias("obs"))
    seen = F.when(F.col("o_orderkey") % 6 == 0, price + 1).otherwise(price)
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1001).alias("observation_id"), F.lit("Total due").alias("text")).unionByName(o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1002).alias("observation_id"), F.concat(F.lit("USD "), F.format_number(seen.cast("double"), 2)).alias("text")))
    return validation.facts_against_lines(facts, lines).select("doc_id", "kind")


@query("""SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'MetadataEngine' WHEN source IN ('src2') THEN 'VisualEngine' ELSE 'Other' END AS engine FROM documents""")
def evidence_engines(spark, sf_dir):
    s = F.when(F.col("source") == "src0", "exiftool.x").when(F.col("source") == "src1", "Some_Analyzer").when(F.col("source") == "src2", "pdf_overlap").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.engine_of(s).alias("engine"))


@query("""SELECT p_partkey, regexp_replace(p_name, ' ', '+', 'g') AS raw, replace(p_name, ' ', '+')[strpos(p_name, ' ') + 1:] AS font FROM part WHERE strpos(p_name, ' ') > 0""")
def font_prefixes(spark, sf_dir):
    raw = F.replace(F.col("p_name"), F.lit(" "), F.lit("+"))
    return table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit(" "))).select("p_partkey", raw.alias("raw"), strings.font_name(raw).alias("font"))
