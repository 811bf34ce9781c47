"""Files, signatures and the objects of pages: metadata conditions, occlusion, kinds of pages. Over documents, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, metadata, tables, visual
from .base import query, table
from .pages import _AREA_A, _AREA_C, _INTER, BOXES, boxes



@query("""WITH k AS (SELECT doc_id, doc_id AS k FROM documents)
SELECT doc_id, 'TEMPORAL_INCONSISTENCY' AS type, 0.88 AS confidence FROM k WHERE abs(k % 90 - k % 50) > 24
UNION ALL SELECT doc_id, 'TEMPORAL_INCONSISTENCY', 0.9 FROM k WHERE 48 - k % 80 < k % 50
UNION ALL SELECT doc_id, 'FS_VS_PDF', 0.88 FROM k WHERE abs(48 - k % 80 - 60) > 24
UNION ALL SELECT doc_id, 'XMP_METADATA_AFTER_CREATE', 0.82 FROM k WHERE (k % 60) * 24 - k % 50 > 720
UNION ALL SELECT doc_id, 'XMP_FORMAT', 0.78 FROM k WHERE k % 3 <> 1
UNION ALL SELECT doc_id, 'COMPANY', 0.95 FROM k WHERE k % 2 = 1
UNION ALL SELECT doc_id, 'ACROFORM', 0.99 FROM k WHERE k % 5 = 0
UNION ALL SELECT doc_id, 'LAYERS', 0.99 FROM k WHERE k % 7 = 0
UNION ALL SELECT doc_id, 'ANNOTATIONS', 0.99 FROM k WHERE k % 11 = 0
UNION ALL SELECT doc_id, 'EMBEDDED_OBJECT', 0.9 FROM k WHERE k % 4 > 0
UNION ALL SELECT doc_id, 'THUMBNAIL', 0.78 FROM k WHERE k % 2 = 0 AND k % 3 <> 0
UNION ALL SELECT doc_id, 'JPEG_QUALITY', 0.85 FROM k WHERE abs(90 - (50 + k % 50)) > 20
UNION ALL SELECT doc_id, 'IMAGE_DIMENSION', 0.92 FROM k WHERE k % 6 > 2 OR k % 4 > 2
UNION ALL SELECT doc_id, 'HIDDEN_TEXT', 0.92 FROM k WHERE k % 9 = 0
UNION ALL SELECT doc_id, 'XMP_DERIVED_FROM', 0.85 FROM k WHERE k % 13 = 0
UNION ALL SELECT doc_id, 'L1_PARTIAL_FAILURE', 1.0 FROM k WHERE k % 17 = 0
UNION ALL SELECT doc_id, 'TRAILING_BYTES', 0.5 FROM k WHERE k % 8 > 0
UNION ALL SELECT doc_id, 'PHOTOSHOP_BLOCK', 0.5 FROM k WHERE k % 19 = 0
UNION ALL SELECT doc_id, 'NO_MAKER_NOTES', 0.5 FROM k WHERE k % 2 = 0 AND k % 10 <> 0
UNION ALL SELECT doc_id, 'STRUCTURAL_ERROR', 0.9 FROM k WHERE k % 23 = 0
UNION ALL SELECT doc_id, 'PNG_CHUNKS', 0.85 FROM k WHERE k % 29 = 0""")
def file_rules_further(spark, sf_dir):
    """The conditions on times, structure and images of files that "file_rules_one_scan" hasn't: one scan, too."""
    k = F.col("doc_id")
    hours = lambda n: F.timestamp_add("HOUR", n.cast("int"), F.lit("2024-01-01").cast("timestamp"))
    some = lambda on, value: F.when(on, F.array(F.lit(value))).otherwise(F.array().cast("array<string>"))
    w = table(spark, sf_dir, "documents").select(
        "doc_id", hours(k % 50).alias("created_at"), hours(k % 90).alias("xmp_created_at"), hours(48 - k % 80).alias("file_modified_at"), hours(F.lit(60)).alias("modified_at"), hours((k % 60) * 24).alias("metadata_at"),
        F.element_at(F.array(F.lit("application/msword"), F.lit("application/pdf"), F.lit("x.officedocument.y")), (k % 3 + 1).cast("int")).alias("format"),
        F.lit("Acme").alias("expected_company"), F.when(k % 2 == 1, "Other").otherwise("ACME Ltd").alias("company"), (k % 5 == 0).alias("has_acroform"), (k % 7 == 0).alias("has_layers"), (k % 11 == 0).alias("has_annotations"),
        (k % 4).alias("embedded_files"), (k % 2 == 0).alias("claims_thumbnail"), (k % 3 == 0).alias("has_thumbnail"), F.lit(90).alias("claimed_quality"), (50 + k % 50).alias("quality"),
        F.lit(100).alias("exif_width"), (100 + k % 6).alias("width"), F.lit(200).alias("exif_height"), (200 - k % 4).alias("height"), some(k % 9 == 0, "#FFFFFF").alias("text_colors"), F.when(k % 13 == 0, "x").otherwise(" ").alias("derived_from"),
        some(k % 17 == 0, "exif").alias("failed_modules"), (k % 8).alias("trailing"), (k % 19 == 0).alias("has_8bim"), F.lit("A").alias("make"), F.when(k % 2 == 0, "B").alias("model"), (k % 10 == 0).alias("has_maker_notes"),
        some(k % 23 == 0, "bad DQT").alias("errors"), some(k % 29 == 0, "IDAT").alias("missing_chunks"))
    return metadata.evidence(w).select("doc_id", "type", "confidence")


@query("""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT doc_id, 'CERTIFICATE_EXPIRED' AS type, 'f' || k AS value FROM s WHERE k % 5 = 0 UNION ALL SELECT doc_id, 'CERTIFICATE_REVOKED', 'f' || k FROM s WHERE k % 7 = 0
UNION ALL SELECT doc_id, 'SIGNATURE_TIME', d || ' 00:00:00' FROM s WHERE d < DATE '1995-01-01' UNION ALL SELECT doc_id, 'SIGNER_ISSUER_INFO', 'Root ' || (k % 3) FROM s WHERE k % 4 > 0
UNION ALL SELECT doc_id, 'MULTI_SIGNATURE', 'partly valid' FROM s GROUP BY doc_id HAVING bool_or(k % 3 > 0) AND NOT bool_and(k % 3 > 0)""")
def signature_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("f"), k.cast("string")).alias("field"), (k % 3 > 0).alias("valid"), (k % 5 == 0).alias("expired"), (k % 7 == 0).alias("revoked"),
        F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00").alias("signing_time"), F.when(k % 4 > 0, F.concat(F.lit("CN=Root "), (k % 3).cast("string"), F.lit(", O=x"))).alias("issuer"))
    made = s.select("doc_id").distinct().withColumn("created_at", F.lit("1995-01-01").cast("timestamp"))
    return metadata.signature_evidence(s, made).select("doc_id", "type", "value")


@query("SELECT doc_id, page::VARCHAR AS value FROM (SELECT l_suppkey AS doc_id, l_linenumber AS page, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n > 20")
def excessive_images(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.count("*").alias("images"))
    return metadata.page_evidence(p).select("doc_id", "value")


@query("""WITH t AS (SELECT doc_id, unnest(['a', 'b', 'c']) AS source, unnest([1, 2, 3]) AS o, unnest(['T' || (doc_id % 3), 'T' || (doc_id % 2), CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'T9' END]) AS software FROM documents)
SELECT doc_id, software, arg_min(source, o) AS source FROM t WHERE trim(software) <> '' GROUP BY ALL""")
def software_provenance(spark, sf_dir):
    name = lambda n: F.concat(F.lit("T"), n.cast("string"))
    k = F.col("doc_id")
    w = table(spark, sf_dir, "documents").select("doc_id", name(k % 3).alias("a"), name(k % 2).alias("b"), F.when(k % 5 == 0, " ").otherwise("T9").alias("c"))
    return metadata.provenance(w, ["a", "b", "c"]).select("doc_id", "software", "source")


_OBJECTS = f"""{BOXES}, q AS (SELECT *, CASE id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'vector' ELSE 'image' END AS kind, id % 2 = 0 AS filled, CASE WHEN id % 4 = 0 THEN 0.5 ELSE 1.0 END AS opacity FROM b),
v AS (SELECT a.page, a.id AS object_id, c.id AS hidden_id, a.kind, c.kind AS hidden, ({_INTER}) / {_AREA_C} AS coverage FROM q a JOIN q c ON a.page = c.page AND a.id > c.id AND {_AREA_A} >= {_AREA_C} AND (a.kind = 'image' OR (a.kind = 'vector' AND a.filled AND a.opacity >= 1)) AND ({_INTER}) / {_AREA_C} >= 0.7)"""


def _objects(spark, sf_dir):
    k = F.col("item_id")
    return boxes(spark, sf_dir).select(F.lit(0).alias("doc_id"), "page", k.alias("object_id"), k.alias("z"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "vector").otherwise("image").alias("kind"), (k % 2 == 0).alias("filled"), F.when(k % 4 == 0, 0.5).otherwise(1.0).alias("opacity"), "box")


@query(f"""WITH {_OBJECTS} SELECT page, object_id, hidden_id, round(least(1.0, CASE WHEN hidden = 'text' THEN 0.6 ELSE 0.5 END + CASE WHEN kind = 'image' THEN 0.1 ELSE 0.2 END + CASE WHEN coverage >= 0.99 THEN 0.1 ELSE 0.0 END), 4) AS confidence FROM v WHERE coverage >= 0.9""")
def occluded_objects(spark, sf_dir):
    hit, _ = visual.occlusions(_objects(spark, sf_dir))
    return hit.select("page", "object_id", "hidden_id", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {_OBJECTS} SELECT page, object_id, hidden_id FROM v WHERE coverage < 0.9 QUALIFY row_number() OVER (PARTITION BY page ORDER BY coverage DESC, object_id, hidden_id) <= 20""")
def near_occlusions(spark, sf_dir):
    _, close = visual.occlusions(_objects(spark, sf_dir))
    return close.select("page", "object_id", "hidden_id")


@query(f"WITH {_OBJECTS} SELECT page, count(*) FILTER (kind = 'text') AS n_text, count(*) FILTER (kind = 'vector') AS n_vector, count(*) FILTER (kind = 'image') AS n_image FROM q GROUP BY page")
def object_pool(spark, sf_dir):
    return visual.object_pool(_objects(spark, sf_dir)).select("page", "n_text", "n_vector", "n_image")


@query("""WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderkey % 300 AS chars, (o_orderkey % 10) / 10.0 AS cover FROM orders), n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i, chars FROM p)
SELECT p.doc_id, p.page, chars > 100 AND cover < 0.5 AS native, CASE WHEN a >= 100 THEN 'native' ELSE 'scanned' END AS source_type FROM p JOIN (SELECT doc_id, avg(chars) AS a FROM n WHERE i <= 5 GROUP BY doc_id) USING (doc_id)""")
def page_and_source_types(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", (F.col("o_orderkey") % 300).alias("chars"), ((F.col("o_orderkey") % 10) / 10).alias("image_cover"))
    p = layout.numbered(p, ["doc_id"], ["o_orderkey"], "page", start=1)
    kinds = layout.source_types(p).select("doc_id", "source_type")
    return layout.page_kinds(p).join(kinds, "doc_id").select("doc_id", F.col("o_orderkey").alias("page"), "native", "source_type")


@query("""SELECT n_nationkey AS k, CASE n_nationkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'list' WHEN 2 THEN 'header' WHEN 3 THEN 'form_field' WHEN 4 THEN 'handwritten' ELSE 'unheard_of' END AS type FROM nation""")
def region_types(spark, sf_dir):
    labels = F.array(*map(F.lit, ["Section_Header", "list_item", "page_header", "key_value_region", "handwritten_text", "unheard_of"]))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), tables.region_type(F.element_at(labels, (F.col("n_nationkey") % 6 + 1).cast("int"))).alias("type"))
