"""Tables and elements rebuilt from boxes. Native where a set-based form exists; grouped functions for the truly sequential folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import joins
from .layout import numbered

#: Layout labels and the types that they stand for.
LABELS = {
    "table": "table",
    "picture": "picture",
    "chart": "chart",
    "paragraph": "paragraph",
    "text": "paragraph",
    "title": "title",
    "section_header": "title",
    "list_item": "list",
    "caption": "caption",
    "footnote": "footnote",
    "reference": "reference",
    "code": "code",
    "formula": "formula",
    "document_index": "index",
    "page_header": "header",
    "page_footer": "footer",
    "form_key": "form_field",
    "key_value_region": "form_field",
    "checkbox_selected": "checkbox",
    "checkbox_unselected": "checkbox",
    "empty_value": "empty_value",
    "handwritten_text": "handwritten",
    "gradient_text": "gradient_text",
    "marker": "marker",
}


def region_type(label: Column) -> Column:
    """The type of a layout label in any case; a label that isn't known stays as it is."""
    by = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(by, F.lower(label)), F.lower(label))


def cluster_rows(items: DataFrame, by: str) -> DataFrame:
    """items (by, item_id, y0, y1) with row_idx: from the top, an item joins the row whose running centre is within half the mean height.

    The centre moves with each item, hence a fold over one table's items at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(c=(pdf.y0 + pdf.y1) / 2, h=pdf.y1 - pdf.y0).sort_values(["c", "item_id"])
        rows, row, center, height, n = [], -1, 0.0, 0.0, 0
        for c, h in zip(pdf.c, pdf.h):
            if row < 0 or abs(c - center) > max(height, h) / 2:
                row, center, height, n = row + 1, c, h, 1
            else:
                center, height, n = (center * n + c) / (n + 1), (height * n + h) / (n + 1), n + 1
            rows.append(row)
        return pdf.assign(row_idx=rows)[[by, "item_id", "row_idx"]]

    kinds = dict(items.dtypes)
    return items.select(by, "item_id", "y0", "y1").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, item_id {kinds['item_id']}, row_idx int")


def column_edges(items: DataFrame, by: list[str], least_share: float = 0.5) -> DataFrame:
    """Columns' inner edges: stretches of x that are free in most rows, each as its middle, in order.

    items: by, row_idx, x0, x1. A row's gaps lie between its items; the depth is the number of rows with a gap there, and
    a peak is a stretch as deep as least_share of the rows and not shallower than its neighbours.
    """
    w = Window.partitionBy(*by, "row_idx").orderBy("x0", "x1")
    gaps = items.withColumn("a", F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("x0") > F.col("a")).select(*by, F.col("a").alias("s"), F.col("x0").alias("e"))
    from .layout import depth_profile

    rows = items.groupBy(*by).agg(F.countDistinct("row_idx").alias("rows"))
    p = depth_profile(gaps, by, "s", "e").join(rows, by)
    v = Window.partitionBy(*by).orderBy("at")
    p = p.withColumn("before", F.coalesce(F.lag("depth").over(v), F.lit(0))).withColumn("after", F.coalesce(F.lead("depth").over(v), F.lit(0)))
    peak = p.filter((F.col("depth") >= least_share * F.col("rows")) & (F.col("depth") >= F.col("before")) & (F.col("depth") > F.col("after")))
    return peak.groupBy(*by).agg(F.array_sort(F.collect_list((F.col("at") + F.col("until")) / 2)).alias("edges"))


def split_at_edges(items: DataFrame, margin: float = 6.0) -> DataFrame:
    """items (item_id, text, box, edges) in pieces: an item that crosses an edge is cut at the blank next to it, if one is within the margin.

    A character's place is its share of the text's width.
    """
    cuts = F.expr("""array_compact(transform(filter(edges, e -> e > box.x0 AND e < box.x1), e -> try_element_at(array_sort(
        transform(filter(sequence(1, length(text)), i -> substring(text, i, 1) = ' ' AND abs(box.x0 + (box.x1 - box.x0) * (i - 0.5D) / length(text) - e) <= MARGIN),
        i -> struct(abs(box.x0 + (box.x1 - box.x0) * (i - 0.5D) / length(text) - e) AS d, i AS i))), 1).i))""".replace("MARGIN", f"{margin}D"))
    ends = F.concat(F.array(F.lit(0)), F.array_sort(F.array_distinct(F.col("cuts"))), F.array(F.length("text") + 1))
    out = items.withColumn("cuts", cuts).withColumn("ends", ends)
    pieces = F.expr("transform(sequence(1, size(ends) - 1), k -> struct(k - 1 AS part, trim(substring(text, ends[k - 1] + 1, ends[k] - ends[k - 1] - 1)) AS text, box.x0 + (box.x1 - box.x0) * ends[k - 1] / greatest(length(text), 1) AS x0, box.x0 + (box.x1 - box.x0) * least(ends[k], length(text)) / greatest(length(text), 1) AS x1))")
    keep = [c for c in items.columns if c not in ("text", "box", "edges")]
    return out.select(*keep, F.explode(pieces).alias("p")).select(*keep, "p.*")


def grid_place(items: DataFrame) -> DataFrame:
    """items (x0, x1, y0, y1, length of text, col_edges, row_edges) with row, col and colspan by the centres of the first and last character."""
    half = (F.col("x1") - F.col("x0")) / (2 * F.greatest(F.col("chars"), F.lit(1)))
    at = lambda edges, v: F.size(F.filter(edges, lambda e: e <= v)) - 1
    first, last = at("col_edges", F.col("x0") + half), at("col_edges", F.col("x1") - half)
    top = F.size("col_edges") - 2
    inside = lambda c: F.greatest(F.lit(0), F.least(c, top))
    out = items.withColumn("col", inside(first)).withColumn("colspan", inside(last) - inside(first) + 1)
    return out.withColumn("row", F.greatest(F.lit(0), F.least(at("row_edges", (F.col("y0") + F.col("y1")) / 2), F.size("row_edges") - 2)))


def containers(regions: DataFrame, least: float = 0.95, children: int = 2) -> DataFrame:
    """regions (doc_id, page, region_id, ord, box) with is_container and container_group_id: a region that holds `children` others is
    a container, and groups are numbered by their first child."""
    by = ["doc_id", "page"]
    other = regions.select(*by, F.col("region_id").alias("outer_id"), F.col("box").alias("other"))
    inside = joins.box_pairs(regions, other, by, (F.col("region_id") != F.col("outer_id")) & (g.area(F.col("other")) > g.area(F.col("box"))) & (g.coverage(F.col("box"), F.col("other")) > least))
    smallest = inside.groupBy(*by, "region_id", "ord").agg(F.min(F.struct(g.area(F.col("other")).alias("a"), "outer_id"))["outer_id"].alias("outer_id"))
    held = smallest.groupBy(*by, "outer_id").agg(F.count("*").alias("n"), F.min("ord").alias("first")).filter(F.col("n") >= children)
    groups = numbered(held, by, ["first", "outer_id"], "container_group_id")
    own = groups.select(*by, F.col("outer_id").alias("region_id"), F.lit(True).alias("is_container"), F.col("container_group_id").alias("own_group"))
    child = smallest.join(groups.select(*by, "outer_id", "container_group_id"), [*by, "outer_id"]).select(*by, "region_id", F.col("container_group_id").alias("in_group"))
    out = regions.join(own, [*by, "region_id"], "left").join(child, [*by, "region_id"], "left")
    return out.select(*regions.columns, F.coalesce("is_container", F.lit(False)).alias("is_container"), F.coalesce("own_group", "in_group").alias("container_group_id"))


def fit_boxes(words: DataFrame) -> DataFrame:
    """words (word_id, want, boxes array<struct<x0,x1>>) with as many boxes as characters: the widest is halved, or the two with the
    least gap are joined, until the number is right; confidence falls by a tenth for each step. A fold over one word."""

    def run(batches):
        for pdf in batches:
            out, conf = [], []
            for want, boxes in zip(pdf.want, pdf.boxes):
                b, steps = sorted((float(x["x0"]), float(x["x1"])) for x in boxes), 0
                while b and len(b) != want and want > 0:
                    steps += 1
                    if len(b) < want:
                        i = max(range(len(b)), key=lambda k: b[k][1] - b[k][0])
                        mid = (b[i][0] + b[i][1]) / 2
                        b[i : i + 1] = [(b[i][0], mid), (mid, b[i][1])]
                    else:
                        i = min(range(len(b) - 1), key=lambda k: b[k + 1][0] - b[k][1])
                        b[i : i + 2] = [(b[i][0], max(b[i][1], b[i + 1][1]))]
                out.append([{"x0": p, "x1": q} for p, q in b])
                conf.append(max(0.0, 1 - steps / 10))
            yield pd.DataFrame({"word_id": pdf.word_id, "boxes": out, "confidence": conf})

    return words.select("word_id", "want", "boxes").mapInPandas(run, f"word_id {dict(words.dtypes)['word_id']}, boxes array<struct<x0:double,x1:double>>, confidence double")


def orphan_paragraphs(lines: DataFrame, by: list[str], share: float = 0.8, least: float = 3.0) -> DataFrame:
    """Unassigned lines (page, y0, y1) with paragraph: one continues while its centre is within share of the mean height of the line before."""
    w = Window.partitionBy(*by, "page").orderBy("y0", "line_id")
    c, h = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    near = F.abs(c - F.lag(c).over(w)) <= F.greatest(F.lit(least), share * (h + F.lag(h).over(w)))
    flagged = lines.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def elements(tables: DataFrame, regions: DataFrame, assigned: DataFrame, lines: DataFrame) -> DataFrame:
    """The stream of a document's elements in order: tables, regions with their lines' text and box, and paragraphs of lines in neither.

    tables: doc_id, page, table_id, box, text; regions: doc_id, page, region_id, element_type, box; lines: doc_id, page,
    line_id, text, box; assigned: doc_id, line_id, region_id. Regions that a table covers by 85 % are left out.
    """
    by = ["doc_id", "page"]
    free = joins.covered(regions.withColumn("item_id", F.col("region_id")), tables.select(*by, F.col("box").alias("other")), by, 0.85)[1]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("box.y0").alias("y"), F.col("box.x0").alias("x"), "text"))), lambda s: s["text"]), " ")
    texts = lines.join(assigned.filter("region_id is not null"), ["doc_id", "line_id"]).groupBy("doc_id", "region_id").agg(joined.alias("text"), F.array_sort(F.collect_set("line_id")).alias("observation_ids"))
    a = tables.select(*by, F.lit("TABLE").alias("element_type"), "text", "box", F.array().cast("array<int>").alias("observation_ids"))
    b = free.join(texts, ["doc_id", "region_id"], "left").select(*by, "element_type", F.coalesce("text", F.lit("")).alias("text"), "box", F.coalesce("observation_ids", F.array().cast("array<int>")).alias("observation_ids"))
    lost = lines.join(assigned.filter("region_id is not null"), ["doc_id", "line_id"], "left_anti").withColumn("y0", F.col("box.y0")).withColumn("y1", F.col("box.y1"))
    c = orphan_paragraphs(lost, ["doc_id"]).groupBy(*by, "paragraph").agg(joined.alias("text"), g.union_of(F.col("box")).alias("box"), F.array_sort(F.collect_set("line_id")).alias("observation_ids")).select(*by, F.lit("PARAGRAPH").alias("element_type"), "text", "box", "observation_ids")
    out = a.unionByName(b).unionByName(c)
    return numbered(out, ["doc_id"], ["page", F.col("box.y0"), F.col("box.x0"), "element_type", "text"], "reading_order_index")


def counters(stream: DataFrame) -> DataFrame:
    n = lambda cond, name: F.count_if(cond).alias(name)
    return stream.groupBy("doc_id").agg(F.count("*").alias("element_count"), n(F.col("element_type") == "TABLE", "table_count"), F.sum(F.size("observation_ids")).alias("observation_count"), n(F.col("text") == "", "empty_count"))


def elements_of(stream: DataFrame) -> DataFrame:
    """doc_id, observation_id, reading_order_index: the element of each line; of several the last."""
    each = stream.select("doc_id", "reading_order_index", F.explode("observation_ids").alias("observation_id"))
    return each.groupBy("doc_id", "observation_id").agg(F.max("reading_order_index").alias("reading_order_index"))


def text_anomalies(spans: DataFrame) -> DataFrame:
    """spans (doc_id, page, span_id, text, font_size, box, page_width, page_height): outside the page, tiny (under 3 points), replacement characters."""
    out = (F.col("box.x1") < 0) | (F.col("box.y1") < 0) | (F.col("box.x0") > F.col("page_width")) | (F.col("box.y0") > F.col("page_height"))
    kinds = F.array_compact(F.array(F.when(out, "out_of_bounds"), F.when(F.col("font_size") < 3, "tiny_text"), F.when(F.contains("text", F.lit("�")), "replacement_char")))
    return spans.select("doc_id", "page", "span_id", F.explode(kinds).alias("kind"))


def slim_sources(rows: DataFrame, heavy: tuple[str, ...] = ("raw_html", "raw_response")) -> DataFrame:
    """rows with sources (array of structs) freed of heavy fields, and their snippets where there is a summary."""
    fields = [f for f in rows.schema["sources"].dataType.elementType.names if f not in heavy]
    slim = lambda s: F.struct(*(F.when(F.col("summary").isNull(), s[f]).alias(f) if f == "snippet" else s[f].alias(f) for f in fields))
    return rows.withColumn("sources", F.transform("sources", slim))


def write_entities(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each kind of entity."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
