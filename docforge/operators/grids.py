"""Tables from a page's drawn rules: rules are snapped and joined, crossings give corners, corners cells, and cells that touch a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import components, joins, layout

#: How far apart, in points, rules may lie that count as one line, as touching and as crossing; rules that are shorter are left out.
TOLERANCE = 3.0
LEAST_LENGTH = 3.0


def rules(drawings: DataFrame, by: list[str], thin: float = TOLERANCE) -> DataFrame:
    """by, across (true for horizontal), at, low, high: a thin box is one rule along its middle, any other box (kind `rect`) four, its sides.

    drawings: by, box, and kind (`line` or `rect`); a line that is neither upright nor level gives none.
    """
    b = F.col("box")
    flat, narrow = g.height(b) <= thin, g.width(b) <= thin
    rule = lambda across, at, low, high: F.struct(F.lit(across).alias("across"), at.cast("double").alias("at"), low.alias("low"), high.alias("high"))
    level, upright = rule(True, g.center_y(b), b["x0"], b["x1"]), rule(False, g.center_x(b), b["y0"], b["y1"])
    sides = F.array(rule(True, b["y0"], b["x0"], b["x1"]), rule(True, b["y1"], b["x0"], b["x1"]), rule(False, b["x0"], b["y0"], b["y1"]), rule(False, b["x1"], b["y0"], b["y1"]))
    none = F.slice(sides, 1, 0)
    each = F.when(flat & (g.width(b) >= g.height(b)), F.array(level)).when(narrow, F.array(upright)).when(F.col("kind") == "rect", sides).otherwise(none)
    return drawings.select(*by, F.explode(each).alias("r")).select(*by, "r.*")


def edges(drawn: DataFrame, by: list[str], tolerance: float = TOLERANCE, least: float = LEAST_LENGTH) -> DataFrame:
    """by, across, at, low, high, edge (a number on the page): rules that lie within the tolerance of the next are set on one line, at their mean, and joined there where they touch.

    Both are sessions in order of place, so that a line drawn in any number of strokes is one edge.
    """
    snapped = layout.sessions(drawn.withColumn("_end", F.col("at")), [*by, "across"], "at", "_end", F.lit(tolerance), ["at", "low", "high"])
    line = snapped.withColumnRenamed("session", "line").drop("_end")
    strokes = layout.sessions(line, [*by, "across", "line"], "low", "high", F.lit(tolerance), ["low", "high"])
    joined = strokes.groupBy(*by, "across", "line", "session").agg(F.sum("at").alias("_sum"), F.count("*").alias("_n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # the mean of all strokes of a line, from its few edges, in the order in which they are numbered
    whole = Window.partitionBy(*by, "across", "line").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    set_ = joined.withColumn("at", F.round(F.sum("_sum").over(whole) / F.sum("_n").over(whole), 4)).filter(F.col("high") - F.col("low") >= least)
    return layout.numbered(set_, by, ["across", "line", "session"], "edge").select(*by, "across", "at", "low", "high", "edge")


def _along(by: list[str], edge: str) -> Window:
    """Windows along an edge (h or v) from its end: all of them share one order, so that windows on one edge that follow each other sort once."""
    return Window.partitionBy(*by, edge).orderBy(F.desc("x" if edge == "h" else "y"))


def crossings(found: DataFrame, by: list[str], tolerance: float = TOLERANCE, rounds: int = 2) -> DataFrame:
    """by, x, y, h, v (edges) of each point where a level edge meets an upright one, within the tolerance; last_x, last_y: none follows on that edge.

    An edge that meets fewer than two others bounds no cell and goes, and so do edges that then meet fewer, `rounds` times.
    """
    t, size = F.lit(tolerance), 128.0
    flat = g.box(F.col("low") - t, F.col("at") - t, F.col("high") + t, F.col("at") + t)
    reach = F.when(F.col("across"), flat).otherwise(g.box("at", "low", "at", "high"))
    # the edges of a grid cell are few, as those on one line lie apart: each upright one gets the level ones by a window, so that what is dealt by page stays where it is
    cell = lambda c: F.floor(F.col(f"reach.{c}") / size).cast("int")
    own = F.struct("edge", "at", "low", "high", cell("x0").alias("cx"), cell("y0").alias("cy"))
    wide = found.withColumn("reach", reach).select(*by, "across", own.alias("e"), F.sequence(cell("y0"), cell("y1")).alias("_ys"), F.explode(F.sequence(cell("x0"), cell("x1"))).alias("_kx"))
    near = wide.select(*by, "across", "e", "_kx", F.explode("_ys").alias("_ky"))
    level = F.collect_list(F.when(F.col("across"), F.col("e"))).over(Window.partitionBy(*by, "_kx", "_ky"))
    both = near.withColumn("level", level).filter("not across").select(*by, "_kx", "_ky", F.col("e").alias("b"), F.explode("level").alias("a"))
    a, b = F.col("a"), F.col("b")
    first = (F.col("_kx") == F.greatest(a["cx"], b["cx"])) & (F.col("_ky") == F.greatest(a["cy"], b["cy"]))  # of the cells that both touch
    on = b["at"].between(a["low"] - t, a["high"] + t) & (b["low"] <= a["at"] + t) & (b["high"] >= a["at"] - t)
    points = both.filter(first & on).select(*by, b["at"].alias("x"), a["at"].alias("y"), a["edge"].alias("h"), b["edge"].alias("v"))
    whole = lambda e: _along(by, e).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ways = ["h", "v"]
    for _ in range(rounds):
        for e in ways:
            points = points.withColumn(f"_{e}", F.count("*").over(whole(e)))
        points = points.filter("_h > 1 and _v > 1").drop("_h", "_v")
        ways.reverse()  # the next begins with the order that this one ends with
    for e in ways:
        c = "x" if e == "h" else "y"
        points = points.withColumn(f"last_{c}", F.col(c) == F.max(c).over(whole(e)))
    return points


def _corners(points: DataFrame, by: list[str]) -> DataFrame:
    """points with r (x, v) and d (y, h): the next crossing on the level edge that goes on downwards, and on the upright one that goes on to the right; null but for corners."""
    right, below = (_along(by, e).rowsBetween(Window.unboundedPreceding, -1) for e in ("h", "v"))
    near = lambda stops, what, w: F.when(~F.col("last_x") & ~F.col("last_y"), F.last(F.when(~F.col(stops), what), ignorenulls=True).over(w))
    return points.withColumn("d", near("last_x", F.struct("y", "h"), below)).withColumn("r", near("last_y", F.struct("x", "v"), right))


def cells(points: DataFrame, by: list[str]) -> DataFrame:
    """by, x0, y0, x1, y1: for each corner the least rectangle (lowest side first, then the right one) whose sides all lie on edges.

    Mostly that is the face at the corner: the next crossing on its level edge that goes on downwards, the next on its upright edge that goes on to the
    right, and the crossing where those two edges meet, each by one look back along an ordered edge. No rectangle is smaller. Only corners whose face is no
    rectangle (a rule ends within it) try the other crossings of their two edges.
    """
    points = components._written(points)
    corner = _corners(points, by).filter("r is not null and d is not null")
    opposite = points.select(*by, F.col("h").alias("_h"), F.col("v").alias("_v"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    met = components._written(corner.select(*by, "x", "y", "h", "v", F.col("d.h").alias("_h"), F.col("r.v").alias("_v")).join(opposite, [*by, "_h", "_v"], "left").drop("_h", "_v"))
    rest = met.filter("x1 is null").drop("x1", "y1")
    sides = points.filter("not last_y").select(*by, "h", F.col("x").alias("x1"), F.col("v").alias("_v"))
    wide = rest.join(sides, [*by, "h"]).filter("x1 > x").join(opposite.drop("x1"), [*by, "_v"]).filter("y1 > y")
    closed = wide.join(points.select(*by, "v", F.col("h").alias("_h")), [*by, "v", "_h"])
    found = closed.groupBy(*by, "x", "y", "h", "v").agg(F.min(F.struct("y1", "x1")).alias("b")).select(*by, "x", "y", F.col("b.x1").alias("x1"), F.col("b.y1").alias("y1"))
    both = met.filter("x1 is not null").select(*by, "x", "y", "x1", "y1").unionByName(found)
    return both.select(*by, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def _runs(rows: DataFrame, by: list[str], fixed: list[str], start: str, end: str, name: str) -> DataFrame:
    """rows with the first cell of the unbroken run of cells of the same two sides that each belongs to."""
    s = layout.sessions(rows, [*by, *fixed], start, end, F.lit(0.0))
    first = F.min(F.struct("x0", "y0")).over(Window.partitionBy(*by, *fixed, "session"))
    return s.withColumn(name, first).drop("session")


def tables(found: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """by, table_id (from 0, by place), row, col, box: cells of tables of `least` cells, numbered by the distinct upper and left sides of their table.

    Cells that share a corner belong together. They are linked by unbroken rows and columns first, so that a table of any size is a few links wide, and
    by their corners (each with the least cell that has it), which at most four cells share.
    """
    c = found.distinct().withColumn("cell", F.struct("x0", "y0"))
    c = _runs(_runs(c, by, ["y0", "y1"], "x0", "x1", "_row"), by, ["x0", "x1"], "y0", "y1", "_col")
    c = components._written(c)
    node = lambda kind, v: F.struct(*by, F.lit(kind).alias("kind"), v.alias("at"))
    row, col = node(0, F.col("_row")), node(1, F.col("_col"))
    corners = F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1"))))
    shared = c.select(*by, corners.alias("p"), "_row").groupBy(*by, "p").agg(F.collect_set("_row").alias("s")).select(*by, F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a <> b")
    links = c.select(row.alias("a"), col.alias("b")).unionByName(shared.select(node(0, F.col("a")).alias("a"), node(0, F.col("b")).alias("b")))
    label = components.connected(links.distinct()).filter("id.kind = 0").select(*(F.col(f"id.{k}").alias(k) for k in by), F.col("id.at").alias("_row"), F.col("label.at").alias("_table"))
    whole = Window.partitionBy(*by, "_table")
    met = c.join(label, [*by, "_row"]).withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") >= least)
    top = met.withColumn("_top", F.min(F.struct("y0", "x0")).over(whole))
    order = lambda *k: F.dense_rank().over(k[0].orderBy(*k[1:])) - 1
    return top.select(
        *by, order(Window.partitionBy(*by), "_top", "_table").alias("table_id"), order(whole, "y0").alias("row"), order(whole, "x0").alias("col"), g.box("x0", "y0", "x1", "y1").alias("box")
    )


def _plain(points: DataFrame, by: list[str]) -> DataFrame:
    """by, x0, y0, x1, y1, row_run, table (numbers of cells) of the corners of pages; x1 is null where the face is no rectangle, as told in `cells`.

    A cell's table is the least cell that an unbroken row, a column and a row lead to. All is told by windows and groups within a page, none by a join.
    """
    met = _corners(points, by)
    # a crossing says where it lies under its own edges, a corner asks under those of the crossing across
    says, asks = F.struct("h", "v", F.lit(False).alias("asks")), F.when(F.col("r").isNotNull() & F.col("d").isNotNull(), F.struct(F.col("d.h").alias("h"), F.col("r.v").alias("v"), F.lit(True).alias("asks")))
    each = met.select(*by, "x", "y", F.explode(F.array(says, asks)).alias("k")).filter("k is not null").select(*by, "x", "y", "k.*")
    at = Window.partitionBy(*by, "h", "v")
    there = lambda c: F.max(F.when(~F.col("asks"), F.col(c))).over(at)
    found = each.withColumn("x1", there("x")).withColumn("y1", there("y")).filter("asks").select(*by, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    c = layout.numbered(found, by, ["y0", "x0"], "table")
    for fixed, start, end, run in ((["y0", "y1"], "x0", "x1", "row_run"), (["x0", "x1"], "y0", "y1", "col_run")):
        c = layout.sessions(c, [*by, *fixed], start, end, F.lit(0.0), [start, "table"]).withColumnRenamed("session", run)
        # along a run numbers rise, so that the least is that of its first cell
        w = Window.partitionBy(*by, *fixed).orderBy(start, "table")
        first = F.when(F.coalesce(F.lag(run).over(w) != F.col(run), F.lit(True)), F.col("table"))
        c = c.withColumn("_first", first).withColumn("_table", F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("table", "_first").withColumnRenamed("_table", "table")
    return c.withColumn("table", F.min("table").over(Window.partitionBy(*by, "y0", "y1", "row_run"))).drop("col_run")


def _odd(plain: DataFrame, by: list[str]) -> DataFrame:
    """by of the pages that `_plain` doesn't finish: a face is no rectangle, or cells that share a corner have two tables."""
    corners = F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1"))))
    shared = plain.select(*by, corners.alias("p"), "table", F.col("x1").isNull().alias("open")).groupBy(*by, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    told = shared.agg(F.min("table").alias("low"), F.max("table").alias("high"), F.max("open").alias("open"))
    return told.filter("open or low <> high").select(*by).distinct()


def table_cells(drawings: DataFrame, by: list[str], tolerance: float = TOLERANCE, least: int = 2) -> DataFrame:
    """by, table_id, row, col, box of the cells of all ruled tables in the drawings (by, kind, box) of each page.

    Drawings that are dealt by page are never shuffled again: windows and groups are by page and edge, crossings are met by grid cells. Pages with a face that is no
    rectangle, or with cells that hang together by more than a row, a column and a row, are told first; only those have their cells written, and linked in rounds.
    A page without crossing rules has no rows.
    """
    points = crossings(edges(rules(drawings, by), by, tolerance), by, tolerance)
    plain = _plain(points, by)
    odd = components._written(_odd(plain, by))
    if not odd.limit(1).count():
        return _numbered_tables(plain, by, least)
    met = joins.small(odd)
    return _numbered_tables(plain.join(met, by, "left_anti"), by, least).unionByName(tables(cells(points.join(met, by, "left_semi"), by), by, least))


def _numbered_tables(plain: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, table_id, row, col, box of the tables of `_plain` that have `least` cells."""
    whole = Window.partitionBy(*by, "table")
    order = lambda w, c: F.dense_rank().over(w.orderBy(c)) - 1
    kept = plain.withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") >= least)
    return kept.select(*by, order(Window.partitionBy(*by), "table").alias("table_id"), order(whole, "y0").alias("row"), order(whole, "x0").alias("col"), g.box("x0", "y0", "x1", "y1").alias("box"))


def regions(found: DataFrame, by: list[str]) -> DataFrame:
    """by, table_id, box, n_rows, n_cols (of the first row), n_cells: a row for each table of table_cells."""
    first: Column = F.count_if(F.col("row") == 0)
    return found.groupBy(*by, "table_id").agg(
        g.union_of(F.col("box")).alias("box"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("*").alias("n_cells"), first.alias("n_first_row")
    )
