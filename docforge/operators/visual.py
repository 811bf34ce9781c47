"""Visual anomalies of pages: occlusion, reuse, spacing, outlined and forged glyphs, baselines, alignment, kinds of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import strings
from . import joins, ransac, stats

PAGE = ["doc_id", "page"]
#: Confidence of an anomaly that states none.
CONFIDENCE = {
    "PDF_SOURCE_TYPE": 0.9, "PDF_TYPOGRAPHY_OUTLIER": 0.7, "PDF_SPAN_FRAGMENTATION_ANOMALY": 0.6, "PDF_CHAR_SPACING_ANOMALY": 0.7, "PDF_OBJECT_OCCLUSION": 0.7, "PDF_OBJECT_REUSE": 0.7, "PDF_OVERLAY_CHARACTERIZATION": 0.6,
    "PDF_COPY_MOVE_CORRELATION": 0.8, "PDF_PARTIAL_OUTLINING": 0.8, "PDF_VECTOR_SPOOFING": 0.8, "PDF_DRAWING_ANOMALY": 0.5, "IMAGE_BASELINE_ANOMALY": 0.7, "IMAGE_ALIGNMENT_ANOMALY": 0.7, "IMAGE_LOW_QUALITY_SEGMENTATION": 0.3, "IMAGE_SOURCE_CLASSIFICATION": 0.9, "IMAGE_PAGE_SKIPPED_CAMERA": 0.9,
}


def to_evidence(anomalies: DataFrame) -> DataFrame:
    """anomalies (doc_id, page, type, value, confidence) with the type's confidence where none or 0 is stated."""
    by_type = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    stated = F.when(F.col("confidence") > 0, F.col("confidence"))
    return anomalies.withColumn("confidence", F.coalesce(stated, F.try_element_at(by_type, F.col("type")), F.lit(0.5))).withColumn("source", F.lit("visual"))


def occlusions(objects: DataFrame, least: float = 0.9, near: float = 0.7, most_near: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pairs of an object that covers `least` of an earlier, smaller or equal one, and the first near ones of each page).

    objects: doc_id, page, object_id, z (order of painting), kind (text, vector, image), filled, opacity, box. Only what hides
    counts: images, and vectors that are filled and opaque; text hides nothing.
    """
    other = objects.select(*PAGE, F.col("object_id").alias("hidden_id"), F.col("z").alias("hz"), F.col("kind").alias("hidden_kind"), F.col("box").alias("other"))
    hides = (F.col("kind") == "image") | ((F.col("kind") == "vector") & F.col("filled") & (F.coalesce("opacity", F.lit(1.0)) >= 1))
    share = g.coverage(F.col("other"), F.col("box"))
    pairs = joins.box_pairs(objects.filter(hides), other, PAGE, (F.col("z") > F.col("hz")) & (g.area(F.col("box")) >= g.area(F.col("other"))) & (share >= near)).withColumn("coverage", share)
    hit = pairs.filter(F.col("coverage") >= least).withColumn("confidence", occlusion_confidence(F.col("kind"), F.col("hidden_kind"), F.col("coverage")))
    w = Window.partitionBy(*PAGE).orderBy(F.desc("coverage"), "object_id", "hidden_id")
    close = pairs.filter(F.col("coverage") < least).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most_near)
    cols = [*PAGE, "object_id", "hidden_id", "kind", "hidden_kind", "coverage"]
    return hit.select(*cols, "confidence"), close.select(*cols)


def occlusion_confidence(kind: Column, hidden: Column, coverage: Column) -> Column:
    base = F.when(hidden == "text", 0.6).otherwise(0.5)
    return F.least(F.lit(1.0), base + F.when(kind == "image", 0.1).otherwise(0.2) + F.when(coverage >= 0.99, 0.1).otherwise(0.0))


def overlays(objects: DataFrame) -> DataFrame:
    """Objects that lie over others without hiding them: half transparent ones, and images."""
    return objects.filter(((F.col("opacity") > 0) & (F.col("opacity") < 1)) | (F.col("kind") == "image"))


def suspicious_images(images: DataFrame, pictures: DataFrame, least: float = 0.5) -> DataFrame:
    """Images that no picture or chart of the layout covers by more than half."""
    return joins.covered(images, pictures, PAGE, least)[1]


def copy_move(occluded: DataFrame, reused: DataFrame) -> DataFrame:
    """Pairs that are both occluded and reused, whichever comes first."""
    pair = lambda a, b: F.array_sort(F.array(a, b))
    a = occluded.withColumn("pair", pair("object_id", "hidden_id"))
    return a.join(reused.select(*PAGE, pair("first", "second").alias("pair")).distinct(), [*PAGE, "pair"], "left_semi")


def object_pool(objects: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return objects.groupBy(*PAGE).agg(n("text"), n("vector"), n("image"))


def char_overlaps(chars: DataFrame, keep: int = 5) -> DataFrame:
    """Neighbouring characters that overlap by more than kerning explains: the first `keep` of each span.

    chars: doc_id, page, span_id, pos, char, box. Fixed values: 12 % of the narrower width, 28 % after punctuation, 45 %
    before it, and a point at least; marks far above or below the line are let be.
    """
    span = [*PAGE, "span_id"]
    w = Window.partitionBy(*span).orderBy("pos")
    nxt, nbox = F.lead("char").over(w), F.lead("box").over(w)
    c = chars.withColumn("next", nxt).withColumn("nbox", nbox).filter("next is not null")
    share = F.when(strings.symbols_only(F.col("next")), 0.45).when(strings.symbols_only(F.col("char")), 0.28).otherwise(0.12)
    allowed = F.greatest(share * F.least(g.width(F.col("box")), g.width(F.col("nbox"))), F.lit(1.0))
    overlap = F.col("box.x1") - F.col("nbox.x0")
    apart = (F.col("nbox.y1") <= F.col("box.y0")) | (F.col("nbox.y0") >= F.col("box.y1"))
    exempt = strings.symbols_only(F.col("next")) & apart
    hit = c.withColumn("overlap", overlap).filter((F.col("overlap") > allowed) & ~exempt)
    return hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select(*span, "pos", "char", "next", "overlap", "n")


def width_outliers(chars: DataFrame, least_delta: float = 0.15, k: float = 3.5) -> DataFrame:
    """Characters (doc_id, font, size, style, char, width) whose width is unlike the others of the same font, size and style.

    Digits are one group where they have one width, else each its own. Groups of 3 to 10: Dixon's test, larger: the modified z.
    """
    base = ["doc_id", "font", "size", "style"]
    digits = chars.filter(F.col("char").rlike("^[0-9]$"))
    tab = stats.tabular_groups(digits, base, "width").select(*base, "tabular")
    one = digits.join(tab, base).withColumn("grp", F.when(F.col("tabular"), F.lit("digit")).otherwise(F.col("char"))).drop("tabular")
    all_ = one.unionByName(chars.filter(~F.col("char").rlike("^[0-9]$")).withColumn("grp", F.col("char")))
    by = [*base, "grp"]
    q = stats.dixon(all_, by, "width").select(*by, "low_is_outlier", "high_is_outlier")
    w = Window.partitionBy(*by)
    few = all_.join(q, by).withColumn("lo", F.min("width").over(w)).withColumn("hi", F.max("width").over(w))
    few = few.filter((F.col("low_is_outlier") & (F.col("width") == F.col("lo"))) | (F.col("high_is_outlier") & (F.col("width") == F.col("hi"))))
    many = stats.with_mad(all_, by, "width", least=11, floor=0.0001).filter((F.col("z") > k) & (F.abs(F.col("width") - F.col("median")) > least_delta))
    cols = [*all_.columns]
    return few.select(*cols).unionByName(many.select(*cols))


def fragmentation(spans: DataFrame, by: list[str], least: int = 5, most_avg: float = 3.0) -> DataFrame:
    """Lines of many very short spans, and single characters among long ones (median of the others of five or more)."""
    n = spans.withColumn("len", F.length("text"))
    lines = n.groupBy(*by).agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.median(F.when(F.col("len") > 1, F.col("len"))).alias("others"), F.count_if(F.col("len") == 1).alias("singles"))
    kind = F.when((F.col("n") >= least) & (F.col("avg") < most_avg), "over_fragmented").when((F.col("singles") == 1) & (F.col("others") >= 5), "isolated_char")
    return lines.withColumn("kind", kind).filter("kind is not null").select(*by, "kind", "n", "avg")


def outlined(drawings: DataFrame, spans: DataFrame) -> DataFrame:
    """Curved drawings whose centre lies in a text line's band but in none of its spans: glyphs drawn, not written.

    drawings: doc_id, page, item_id, bezier_count, box; spans: doc_id, page, line_id, box. Three curves, height by width .15 to 6.
    """
    ratio = g.aspect(F.col("box"))
    glyphs = drawings.filter((F.col("bezier_count") >= 3) & ratio.between(0.15, 6.0))
    lines = spans.groupBy(*PAGE, "line_id").agg(g.union_of(F.col("box")).alias("other"))
    in_line = joins.box_pairs(glyphs, lines, PAGE, g.center_in(F.col("box"), F.col("other")))
    first = in_line.groupBy(*PAGE, "item_id").agg(F.min(F.struct("line_id", "box")).alias("l")).select(*PAGE, "item_id", F.col("l.line_id").alias("line_id"), F.col("l.box").alias("box"))
    own = spans.select(*PAGE, "line_id", F.col("box.x0").alias("sx0"), F.col("box.x1").alias("sx1"))
    inside = first.join(own, [*PAGE, "line_id"]).filter(g.center_x(F.col("box")).between(F.col("sx0"), F.col("sx1"))).select(*PAGE, "item_id").distinct()
    return first.join(inside, [*PAGE, "item_id"], "left_anti")


def micro_vectors(drawings: DataFrame, chars: DataFrame, zones: DataFrame, least: float = 0.3, keep: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tiny drawings that touch characters outside structural zones, with the first hit characters; all tiny candidates).

    Fixed values: 5 points or .6 of the font size; underlines of 10 x 2 and rules of 2 x 20 are left out.
    drawings: item_id, box; chars: char_id, char, font_size, other; zones: other (tables and figures).
    """
    b = F.col("box")
    underline = (g.width(b) >= 10) & (g.height(b) <= 2)
    rule = ((g.width(b) <= 2) & (g.height(b) >= 20)) | ((g.width(b) >= 50) & (g.height(b) >= 20))
    tiny = drawings.filter(~underline & ~rule & (F.greatest(g.width(b), g.height(b)) <= 20))
    free = joins.covered(tiny, zones, PAGE, 0.5)[1]
    small = F.greatest(g.width(b), g.height(b)) <= F.greatest(F.lit(5.0), 0.6 * F.col("font_size"))
    pairs = joins.box_pairs(free, chars.select(*PAGE, "char_id", "char", "font_size", "other"), PAGE, (g.coverage(F.col("other"), b) >= least) & small)
    hits = pairs.groupBy(*PAGE, "item_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("char_id", "char"))), 1, keep).alias("chars"), F.count("*").alias("n"))
    return hits, tiny.select(*PAGE, "item_id")


def baseline_outliers(glyphs: DataFrame, by: list[str], **options) -> DataFrame:
    """Glyphs (x, bottom, height, class, confidence, char_confidence) that stand off their line (`ransac.baseline_outliers`); without char_confidence the one confidence counts."""
    whole = glyphs if "char_confidence" in glyphs.columns else glyphs.withColumn("char_confidence", F.lit(1.0))
    return ransac.baseline_outliers(whole, by, **options)


def chars_to_cells(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Each character (char_id, box) with the first cell (row, col, other) of its page that has its centre or half of it."""
    on = g.center_in(F.col("box"), F.col("other")) | (g.coverage(F.col("box"), F.col("other")) >= 0.5)
    pairs = joins.box_pairs(chars, cells.select(*PAGE, "table_id", "row", "col", "other"), PAGE, on)
    return pairs.groupBy(*PAGE, "char_id").agg(F.min(F.struct("row", "col", "table_id")).alias("c")).select(*PAGE, "char_id", "c.*")


def alignment_outliers(cells: DataFrame, least: int = 3, k: float = 3.5, least_px: float = 6.0) -> DataFrame:
    """Cells (doc_id, table_id, row, col, left, mid, right) off their column's best axis; header cells are forgiven."""
    by = ["doc_id", "table_id", "col"]
    n = cells.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")
    kept = cells.join(n, by)
    axis = stats.best_axis(kept, by, ["left", "mid", "right"]).drop("mad")
    pos = F.when(F.col("axis") == "left", F.col("left")).when(F.col("axis") == "mid", F.col("mid")).otherwise(F.col("right"))
    scored = stats.with_mad(kept.join(axis, by).withColumn("at", pos.cast("double")), by, "at")
    hit = scored.filter((F.col("z") > k) & (F.abs(F.col("at") - F.col("median")) > least_px))
    return stats.forgive_headers(hit, ["doc_id", "table_id"], "row", "col").select("doc_id", "table_id", "row", "col", "axis", "z")


def camera_score(rows: DataFrame) -> DataFrame:
    """rows (solid: share of pure background, peak_width: bins, concentration: share of the ten fullest bins) with score and source.

    A narrow, concentrated histogram on a solid ground is a digital image. Fixed values: .4 and .6, .55.
    """
    narrow = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (40 - F.col("peak_width")) / 35.0))
    full = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("concentration") - 0.3) / 0.5))
    score = 0.4 * F.col("solid") + 0.6 * F.least(narrow, full)
    return rows.withColumn("score", score).withColumn("source_type", F.when(score >= 0.55, "digital").otherwise("camera"))


def page_type(observations: DataFrame) -> DataFrame:
    """By the sources of a page's lines: native, scanned, or mixed."""
    s = observations.groupBy(*PAGE).agg(F.collect_set("source").alias("s"))
    native, ocr = F.array_contains("s", "pdf_native"), F.size(F.array_remove("s", "pdf_native")) > 0
    return s.select(*PAGE, F.when(native & ocr, "mixed").when(native, "native").otherwise("scanned").alias("page_type"))


def merge_boxes(boxes: Column, least: float = 0.4) -> Column:
    """array<struct<x0,x1>> in order of x0, merged where they overlap by more than `least` of the narrower: a fold."""
    zero = F.slice(boxes, 1, 0)

    def step(out: Column, b: Column) -> Column:
        last = F.element_at(out, -1)
        shared = F.least(last["x1"], b["x1"]) - F.greatest(last["x0"], b["x0"])
        merge = (F.size(out) > 0) & (shared > least * F.least(last["x1"] - last["x0"], b["x1"] - b["x0"]))
        one = F.struct(last["x0"].alias("x0"), F.greatest(last["x1"], b["x1"]).alias("x1"))
        return F.when(merge, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(F.array_sort(boxes), zero, step)


def consensus(regions: DataFrame, least: float = 0.3, alone: float = 0.7) -> DataFrame:
    """Clusters of overlapping regions (doc_id, page, region_id, model, confidence, box) of two models or more: size, mean
    confidence, models; a document without one keeps its single confident regions."""
    from .components import connected

    other = regions.select(*PAGE, F.col("region_id").alias("other_id"), F.col("box").alias("other"))
    node = lambda c: F.struct(*PAGE, F.col(c).alias("region_id"))  # noqa: E731  identifiers may repeat on other pages and in other documents
    pairs = joins.box_pairs(regions, other, PAGE, (F.col("region_id") < F.col("other_id")) & (g.iou(F.col("box"), F.col("other")) >= least))
    label = connected(pairs.select(node("region_id").alias("a"), node("other_id").alias("b"))).select("id.*", F.col("label.region_id").alias("label"))
    c = regions.join(label, [*PAGE, "region_id"]).groupBy(*PAGE, "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_set("model")).alias("models")).filter(F.size("models") >= 2)
    single = regions.join(c.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.col("confidence") > alone)
    return c.unionByName(single.select(*PAGE, F.col("region_id").alias("label"), F.lit(1).cast("long").alias("n"), "confidence", F.array("model").alias("models")))


def page_summary(anomalies: DataFrame) -> DataFrame:
    """n and the largest confidence by page, and the anomalies of each type."""
    t = anomalies.groupBy(*PAGE, "type").agg(F.count("*").alias("n"), F.max("confidence").alias("m"))
    return t.groupBy(*PAGE).agg(F.sum("n").alias("n"), F.max("m").alias("most"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
