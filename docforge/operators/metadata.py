"""Evidence from file metadata: all conditions on one wide row a document, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.dates import to_timestamp
from ..sources.dimensions import TOOL_CATEGORIES

STANDARD_FONTS = ["Courier", "Helvetica", "Times-Roman", "Symbol", "ZapfDingbats", "Arial", "Times New Roman"]
WHITES = ["#FFFFFF", "#FFFFFE", "#FFFEFE", "#FEFEFE"]
DAY = 86_400


def seconds(a: str, b: str) -> Column:
    return F.unix_timestamp(a) - F.unix_timestamp(b)


def has(column: str, *parts: str) -> Column:
    return F.coalesce(F.lower(column).rlike("|".join(parts)), F.lit(False))


def item(kind: str, value, confidence, description: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), F.lit(description).alias("description"))


#: kind, condition, value, confidence, description, columns that it needs. Confidences and limits are fixed values.
def rules() -> list[tuple]:
    c = F.col
    editor = has("producer", "photoshop", "canva") | has("creator", "photoshop", "canva")
    shop = has("producer", "photoshop") | has("creator", "photoshop")
    ratio = F.try_divide(c("page_width"), c("page_height"))
    off = lambda a, b: F.abs(c(a) - c(b)) > 2
    return [
        ("TEMPORAL_INCONSISTENCY", c("modified_at") < c("created_at"), c("modified_at"), 0.95, "changed before it was made", ["modified_at", "created_at"]),
        ("TEMPORAL_INCONSISTENCY", F.abs(seconds("xmp_created_at", "created_at")) > DAY, c("xmp_created_at"), 0.88, "two times of making over a day apart", ["xmp_created_at", "created_at"]),
        ("TEMPORAL_INCONSISTENCY", c("file_modified_at") < c("created_at"), c("file_modified_at"), 0.90, "the file is older than the document", ["file_modified_at", "created_at"]),
        ("INCREMENTAL_UPDATE", (c("revisions") > 3) & editor, c("revisions"), 0.92, "many revisions by an image editor", ["revisions", "producer", "creator"]),
        ("STRUCTURE_SOFTWARE_MISMATCH", c("linearized") & shop, "linearized", 0.75, "linearized by an image editor", ["linearized", "producer", "creator"]),
        ("FONT_ANOMALY", shop & (F.size("fonts") > 0) & (F.size(F.array_except("fonts", F.array(*map(F.lit, STANDARD_FONTS)))) == 0), F.array_join("fonts", ","), 0.70, "an image editor with standard fonts only", ["fonts", "producer", "creator"]),
        ("FONT_ANOMALY", F.size("fonts") > 6, F.size("fonts"), 0.65, "more than six fonts", ["fonts"]),
        ("PAGE_DIMENSION", (ratio < 0.8) | (ratio > 2), ratio, 0.85, "unusual page", ["page_width", "page_height"]),
        ("XMP_FORMAT", has("format", "msword", "officedocument"), c("format"), 0.78, "a word processor's format", ["format"]),
        ("XMP_METADATA_AFTER_CREATE", seconds("metadata_at", "created_at") > 30 * DAY, c("metadata_at"), 0.82, "metadata over 30 days younger", ["metadata_at", "created_at"]),
        ("ENCODING", F.coalesce(strings.has_control(c("title")), F.lit(False)) | F.coalesce(strings.has_control(c("subject")), F.lit(False)), c("title"), 0.90, "control characters", ["title", "subject"]),
        ("COMPANY", strings.tools_differ(c("expected_company"), c("company")), c("company"), 0.95, "another company", ["expected_company", "company"]),
        ("FS_VS_PDF", F.abs(seconds("file_modified_at", "modified_at")) > DAY, c("file_modified_at"), 0.88, "file and document over a day apart", ["file_modified_at", "modified_at"]),
        ("OBJECT_STREAM", F.try_divide(c("object_streams"), c("objects")) > 0.8, F.try_divide(c("object_streams"), c("objects")), 0.75, "mostly object streams", ["object_streams", "objects"]),
        ("ACROFORM", c("has_acroform"), "acroform", 0.99, "a form", ["has_acroform"]),
        ("LAYERS", c("has_layers"), "layers", 0.99, "layers", ["has_layers"]),
        ("ANNOTATIONS", c("has_annotations"), "annotations", 0.99, "annotations", ["has_annotations"]),
        ("OBJECT_GRAPH", c("objects") > 500, c("objects"), 0.70, "more than 500 objects", ["objects"]),
        ("EMBEDDED_OBJECT", c("embedded_files") > 0, c("embedded_files"), 0.90, "embedded files", ["embedded_files"]),
        ("HIDDEN_TEXT", F.size(F.array_intersect("text_colors", F.array(*map(F.lit, WHITES)))) > 0, F.array_join("text_colors", ","), 0.92, "white text", ["text_colors"]),
        ("IMAGE_DIMENSION", off("exif_width", "width") | off("exif_height", "height"), c("width"), 0.92, "other dimensions than stated", ["exif_width", "width", "exif_height", "height"]),
        ("THUMBNAIL", c("claims_thumbnail") & ~c("has_thumbnail"), "thumbnail", 0.78, "a thumbnail is missing", ["claims_thumbnail", "has_thumbnail"]),
        ("JPEG_QUALITY", F.abs(c("claimed_quality") - c("quality")) > 20, c("quality"), 0.85, "another quality than stated", ["claimed_quality", "quality"]),
        ("STRUCTURAL_ERROR", F.size("errors") > 0, strings.first_hit(F.array_join("errors", ";"), [("dqt", "DQT"), ("dht", "DHT"), ("chunk", "PNG_CHUNK"), ("ihdr", "PNG_CHUNK"), ("iend", "PNG_CHUNK")], "HEADER"), 0.90, "broken structure", ["errors"]),
        ("PNG_CHUNKS", F.size(F.array_intersect("missing_chunks", F.array(F.lit("IHDR"), F.lit("IDAT")))) > 0, F.array_join("missing_chunks", ","), 0.85, "chunks are missing", ["missing_chunks"]),
        ("UNKNOWN_PRODUCER", c("best_producer").isNull(), c("producer"), 0.50, "no known producer", ["best_producer", "producer"]),
        ("METADATA_SOFTWARE", c("best_producer").isNotNull(), c("best_producer"), c("best_score"), "producer", ["best_producer", "best_score"]),
        ("MULTIPLE_PRODUCER_SIGNATURES", c("second_score") > 0.3, c("second_producer"), 0.60, "a second producer", ["second_producer", "second_score"]),
        ("PRODUCER_RISK", c("risk_level").isNotNull(), c("risk_level"), c("best_score") * 0.9, "risk of the producer for this type", ["risk_level", "best_score"]),
        ("CREATOR_PRODUCER_RELATION", _relation(), F.concat_ws(" > ", _category("creator"), _category("producer")), 0.88, "made and distilled by unlike tools", ["creator", "producer"]),
        ("XMP_HISTORY_CHAIN", F.size(strings.xmp_history(c("history"))) > 0, F.size(strings.xmp_history(c("history"))), 0.92, "a history of edits", ["history"]),
        ("XMP_TOOL_MISMATCH", strings.tools_differ(c("creator"), c("producer")), c("creator"), 0.78, "two tools", ["creator", "producer"]),
        ("XMP_DERIVED_FROM", F.trim("derived_from") != "", c("derived_from"), 0.85, "made from another document", ["derived_from"]),
        ("L1_PARTIAL_FAILURE", F.size("failed_modules") > 0, F.array_join("failed_modules", ","), 1.0, "modules failed", ["failed_modules"]),
        ("THUMBNAIL_ASPECT", F.abs(F.try_divide(c("thumb_width") / c("thumb_height"), c("width") / c("height")) - 1) > 0.15, "aspect", 0.5, "the thumbnail has another shape", ["thumb_width", "thumb_height", "width", "height"]),
        ("TRAILING_BYTES", c("trailing") > 0, c("trailing"), 0.5, "bytes after the image", ["trailing"]),
        ("PHOTOSHOP_BLOCK", c("has_8bim"), "8BIM", 0.5, "an image editor's block", ["has_8bim"]),
        ("NO_MAKER_NOTES", c("make").isNotNull() & c("model").isNotNull() & ~c("has_maker_notes"), c("model"), 0.5, "a camera without its notes", ["make", "model", "has_maker_notes"]),
    ]


def _category(column: str) -> Column:
    return strings.first_hit(F.col(column), TOOL_CATEGORIES)


def _relation() -> Column:
    made, done = _category("creator"), _category("producer")
    return F.coalesce((made != done), F.lit(False)) | (made.isNull() & (done == "online_converter")) | (F.coalesce(done == "scan_capture", F.lit(False)) & F.col("creator").isNotNull())


def evidence(wide: DataFrame, only: list[str] | None = None) -> DataFrame:
    """doc_id, type, value, confidence, description for every condition whose columns wide has and that holds."""
    used = [r for r in rules() if set(r[5]) <= set(wide.columns) and (only is None or r[0] in only)]
    each = [F.when(F.coalesce(cond, F.lit(False)), item(kind, value, conf, text)) for kind, cond, value, conf, text, _ in used]
    return wide.select("doc_id", F.explode(F.array_compact(F.array(*each))).alias("e")).select("doc_id", "e.*")


def page_evidence(pages: DataFrame, most: int = 20) -> DataFrame:
    """pages (doc_id, page, images): more than `most` images on a page."""
    return pages.filter(F.col("images") > most).select("doc_id", F.lit("EXCESSIVE_IMAGES").alias("type"), F.col("page").cast("string").alias("value"), F.lit(0.80).alias("confidence"), F.lit("many images").alias("description"))


def signature_evidence(signatures: DataFrame, created: DataFrame) -> DataFrame:
    """Expired and revoked certificates, signing before making, the issuers' names, and documents of which only some signatures are valid."""
    s = signatures.join(created.select("doc_id", "created_at"), "doc_id", "left")
    cn = strings.common_name(F.col("issuer"))
    each = [
        F.when(F.col("expired"), item("CERTIFICATE_EXPIRED", F.col("field"), 0.98, "expired")),
        F.when(F.col("revoked"), item("CERTIFICATE_REVOKED", F.col("field"), 0.99, "revoked")),
        F.when(to_timestamp(F.col("signing_time")) < F.col("created_at"), item("SIGNATURE_TIME", F.col("signing_time"), 0.95, "signed before it was made")),
        F.when(cn.isNotNull(), item("SIGNER_ISSUER_INFO", cn, 0.99, "issuer")),
    ]
    rows = s.select("doc_id", F.explode(F.array_compact(F.array(*each))).alias("e")).select("doc_id", "e.*")
    some = signatures.groupBy("doc_id").agg((F.bool_or("valid") & ~F.bool_and("valid")).alias("m")).filter("m")
    return rows.unionByName(some.select("doc_id", item("MULTI_SIGNATURE", "partly valid", 0.98, "some signatures are invalid").alias("e")).select("doc_id", "e.*"))


def timeline(wide: DataFrame, columns: dict[str, str]) -> DataFrame:
    """doc_id, at, source in order of time, each pair of time and source once. columns: column -> source."""
    long = wide.select("doc_id", F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(s).alias("source")) for c, s in columns.items()))).alias("t")).select("doc_id", "t.*")
    out = long.filter("at is not null").distinct()
    from pyspark.sql import Window

    return out.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "source")))


def provenance(wide: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, software, source: each name of a tool once, with the first listed column that has it."""
    long = wide.select("doc_id", F.explode(F.array(*(F.struct(F.trim(c).alias("software"), F.lit(i).alias("o"), F.lit(c).alias("source")) for i, c in enumerate(columns)))).alias("t")).select("doc_id", "t.*")
    return long.filter("software is not null and software <> ''").groupBy("doc_id", "software").agg(F.min_by("source", "o").alias("source"), F.min("o").alias("o"))


def unused_fonts(registered: DataFrame, used: DataFrame) -> DataFrame:
    """Fonts (doc_id, font, page) that no text uses, with their pages; subset prefixes are dropped first."""
    a = registered.withColumn("font", strings.font_name(F.col("font")))
    b = used.select("doc_id", strings.font_name(F.col("font")).alias("font")).distinct()
    return a.join(b, ["doc_id", "font"], "left_anti").groupBy("doc_id", "font").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def annotations(rows: DataFrame) -> DataFrame:
    """Annotations (doc_id, page, kind, target, source) once for each place and target, with all their sources."""
    return rows.groupBy("doc_id", "page", "kind", strings.uri(F.col("target")).alias("target")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def best_producers(scores: DataFrame, least_second: float = 0.3) -> DataFrame:
    """doc_id with the best producer and the second, if it scores more than least_second."""
    top = scores.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "producer"))).alias("t"))
    first, second = F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(2))
    return top.select("doc_id", first["producer"].alias("best_producer"), (-first["s"]).alias("best_score"), F.when(-second["s"] > least_second, second["producer"]).alias("second_producer"), F.when(-second["s"] > least_second, -second["s"]).alias("second_score"))
