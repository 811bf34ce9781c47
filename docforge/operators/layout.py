"""Lines, gaps, chunks and reading order of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "n", start: int = 0) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + start)


def sessions(rows: DataFrame, by: list[str], start: str, end: str, gap: Column, order: list | None = None) -> DataFrame:
    """rows with session (from 0): a new one begins where start exceeds the largest end before by more than gap."""
    w = Window.partitionBy(*by).orderBy(*(order or [start]))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def gaps(rows: DataFrame, by: list[str], start: str, end: str, least: float) -> DataFrame:
    """Free intervals (gap_start, gap_end) of `least` between the intervals of each group, by a sweep with the running largest end."""
    w = Window.partitionBy(*by).orderBy(start, end)
    swept = rows.withColumn("gap_start", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap_end", F.col(start))
    return swept.filter(F.col("gap_end") - F.col("gap_start") >= least).select(*by, "gap_start", "gap_end")


def edges(found: DataFrame, extent: DataFrame, by: list[str]) -> DataFrame:
    """Column edges: the extent's ends and the middle of each gap, in order."""
    mids = found.groupBy(*by).agg(F.array_sort(F.collect_list((F.col("gap_start") + F.col("gap_end")) / 2)).alias("m"))
    j = extent.join(mids, by, "left")
    return j.select(*by, F.concat(F.array("low"), F.coalesce("m", F.array().cast("array<double>")), F.array("high")).alias("edges"))


def depth_profile(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """How many intervals cover the stretch from each event to the next: at, until, depth."""
    events = rows.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.*")
    sums = events.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at")
    return sums.withColumn("depth", F.sum("d").over(w)).withColumn("until", F.lead("at").over(w)).filter("until is not null").drop("d")


def chunks(rows: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    return numbered(rows, by, order, "_n").withColumn("chunk", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def budget_chunks(rows: DataFrame, by: list[str], order: str, chars: Column, most: int = 100, most_chars: int = 50_000, overhead: int = 100) -> DataFrame:
    """by, chunk, first and last order, n: rows in order, a new chunk where the next would exceed the count or the characters.

    Greedy, hence a fold over each document's rows in order; it keeps one number for each chunk that it closes, and rows are dealt to chunks afterwards.
    """
    sizes = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (chars + overhead).cast("long").alias("c")))).alias("s"))
    zero = F.expr("struct(0L AS i, 0L AS n, 0L AS chars, CAST(array() AS ARRAY<BIGINT>) AS starts)")

    def step(a: Column, x: Column) -> Column:
        new = (a["i"] == 0) | (a["n"] >= most) | (a["chars"] + x["c"] > most_chars)
        starts = F.when(new, F.array_append(a["starts"], a["i"])).otherwise(a["starts"])
        return F.struct((a["i"] + 1).alias("i"), F.when(new, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"), F.when(new, x["c"]).otherwise(a["chars"] + x["c"]).alias("chars"), starts.alias("starts"))

    folded = sizes.withColumn("_k", F.aggregate("s", zero, step, lambda a: a["starts"]))
    chunk = folded.select(*by, "s", F.size("s").alias("_size"), "_k", F.posexplode("_k").alias("chunk", "_from"))
    to = F.coalesce(F.get("_k", F.col("chunk") + 1), F.col("_size").cast("long"))
    at = lambda i: F.get("s", i.cast("int"))["o"]
    return chunk.select(*by, "chunk", at(F.col("_from")).alias("first"), at(to - 1).alias("last"), (to - F.col("_from")).alias("n"))


#: Points by which text may lie off its page.
OFF_PAGE = 20


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, block_id, line_id, span_index, text, box, color, font_size) to observations of one line each.

    Blank, near-white, absurdly small or large text is dropped before, and what lies more than 20 points off the page, where
    page_width and page_height are given; the identifier is page * 1000 + number on the page.
    """
    from ..functions.values import is_near_white, observation_id

    b = F.col("box")
    near = (b["x1"] >= -OFF_PAGE) & (b["y1"] >= -OFF_PAGE)
    if {"page_width", "page_height"} <= set(spans.columns):
        near = near & (b["x0"] <= F.col("page_width") + OFF_PAGE) & (b["y0"] <= F.col("page_height") + OFF_PAGE)
    kept = spans.filter(near & (F.trim("text") != "") & ~is_near_white(F.col("color")) & F.col("font_size").between(1, 500))
    lines = kept.groupBy("doc_id", "page", "block_id", "line_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_index", "text"))), lambda s: s["text"]), "").alias("text"), g.union_of(F.col("box")).alias("box"))
    out = numbered(lines, ["doc_id", "page"], ["block_id", "line_id"], "_n")
    return out.withColumn("observation_id", observation_id(F.col("page"), F.col("_n"))).drop("_n")


def page_kinds(pages: DataFrame, least_chars: int = 100, most_cover: float = 0.5) -> DataFrame:
    """pages (doc_id, page, chars, image_cover) with native: enough text and not mostly an image."""
    return pages.withColumn("native", (F.col("chars") > least_chars) & (F.col("image_cover") < most_cover))


def source_types(pages: DataFrame, first: int = 5, least: int = 100) -> DataFrame:
    return pages.filter(F.col("page") <= first).groupBy("doc_id").agg(F.avg("chars").alias("chars")).withColumn("source_type", F.when(F.col("chars") >= least, "native").otherwise("scanned"))


def skew_angle(segments: DataFrame, by: list[str], least: int = 4, most: float = 15.0, ignore: float = 0.2) -> DataFrame:
    """Median angle of text lines (dx, dy) in degrees; 0 under `ignore` or with fewer than `least` lines."""
    a = segments.withColumn("_a", F.degrees(F.atan2("dy", "dx"))).filter(F.abs("_a") < most)
    out = a.groupBy(*by).agg(F.count("*").alias("n"), F.median("_a").alias("m"))
    return out.select(*by, F.when((F.col("n") >= least) & (F.abs("m") >= ignore), F.col("m")).otherwise(0.0).alias("angle"))


def reading_order(elements: DataFrame, orphans: DataFrame, by: list[str]) -> DataFrame:
    """elements (rank, page, y0) with orphans (page, y0) put before the first element that lies further on, numbered anew from 0."""
    e = elements.select(*by, F.lit(None).cast("long").alias("orphan_id"), "page", "y0", "rank", F.lit(1).alias("kind"))
    o = orphans.select(*by, F.col("orphan_id").cast("long").alias("orphan_id"), "page", "y0", F.lit(None).cast(dict(elements.dtypes)["rank"]).alias("rank"), F.lit(0).alias("kind"))
    # in order of place, elements before orphans of the same place: the least rank of all that follow. Told from the end, as a running
    # least: a frame that ends at the last row is summed anew for each row
    w = Window.partitionBy(*by).orderBy(F.desc("page"), F.desc("y0"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.coalesce(F.min("rank").over(w).cast("double"), F.lit(float("inf")))
    both = e.unionByName(o).withColumn("key", F.when(F.col("kind") == 1, F.col("rank").cast("double")).otherwise(anchor)).drop("rank")
    return numbered(both, by, ["key", "kind", "page", "y0", "orphan_id"], "reading_order_index").drop("key")


def table_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells (row, col, text) as lines `a | b`."""
    rows = cells.groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: F.coalesce(c["text"], F.lit(""))), " | ").alias("line"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("text"))


def element_text(kind: Column, ids: Column, text: Column) -> Column:
    from ..functions.arrays import compress_ids

    return F.concat(F.lit("["), kind, F.lit("] obs="), F.array_join(compress_ids(ids), ","), F.lit(" | "), text)


def reused(objects: DataFrame, by: list[str], key: str, least_shift: float = 20.0, size_tolerance: float = 0.02) -> DataFrame:
    """Objects of the same content that a page has exactly twice, of about one size and far enough apart."""
    g2 = objects.groupBy(*by, key).agg(F.count("*").alias("n"), F.min(F.struct("object_id", "box")).alias("a"), F.max(F.struct("object_id", "box")).alias("b")).filter("n = 2")
    a, b = F.col("a.box"), F.col("b.box")
    alike = (F.abs(g.width(a) - g.width(b)) <= size_tolerance * F.greatest(g.width(a), g.width(b))) & (F.abs(g.height(a) - g.height(b)) <= size_tolerance * F.greatest(g.height(a), g.height(b)))
    shift = F.sqrt(F.pow(g.center_x(a) - g.center_x(b), 2) + F.pow(g.center_y(a) - g.center_y(b), 2))
    return g2.filter(alike & (shift > least_shift)).select(*by, key, F.col("a.object_id").alias("first"), F.col("b.object_id").alias("second"), shift.alias("shift"))


def drawing_hash(ops: Column, x0: Column, y0: Column) -> Column:
    """ops: array<struct<op, x, y>>; sixteen digits of the MD5 of the operations relative to the box's corner."""
    rel = F.transform(ops, lambda o: F.concat_ws(",", o["op"], F.format_string("%.2f", o["x"] - x0), F.format_string("%.2f", o["y"] - y0)))
    return F.substring(F.md5(F.array_join(rel, "|")), 1, 16)
