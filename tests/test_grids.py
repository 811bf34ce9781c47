"""Ruled tables against a brute-force search for least rectangles."""

import random

from pyspark.sql import functions as F

from docforge.functions import geometry as g
from docforge.operators import grids


def drawn(spark, rows):
    """rows: page, kind, x0, y0, x1, y1."""
    d = spark.createDataFrame([(p, k, *map(float, b)) for p, k, *b in rows], "page int, kind string, x0 double, y0 double, x1 double, y1 double")
    return d.select("page", "kind", g.box("x0", "y0", "x1", "y1").alias("box"))


def brute(levels, uprights):
    """levels: (y, x0, x1), uprights: (x, y0, y1), whole numbers, one edge each: cells by trying all rectangles, tables by shared corners."""
    points = {(x, y) for y, a, b in levels for x, c, d in uprights if a <= x <= b and c <= y <= d}
    joined = lambda p, q: any(y == p[1] == q[1] and a <= min(p[0], q[0]) and max(p[0], q[0]) <= b for y, a, b in levels) if p[1] == q[1] else any(x == p[0] == q[0] and c <= min(p[1], q[1]) and max(p[1], q[1]) <= d for x, c, d in uprights)
    cells = []
    for p in points:
        best = None
        for y in sorted(q[1] for q in points if q[0] == p[0] and q[1] > p[1]):
            for x in sorted(q[0] for q in points if q[1] == p[1] and q[0] > p[0]):
                if best is None and (x, y) in points and joined(p, (x, p[1])) and joined(p, (p[0], y)) and joined((x, p[1]), (x, y)) and joined((p[0], y), (x, y)):
                    best = (*p, x, y)
        if best:
            cells.append(best)
    tables, left = [], set(cells)
    while left:
        now, todo = set(), [left.pop()]
        while todo:
            c = todo.pop()
            now.add(c)
            corners = {(c[i], c[j]) for i in (0, 2) for j in (1, 3)}
            near = {d for d in left if corners & {(d[i], d[j]) for i in (0, 2) for j in (1, 3)}}
            left -= near
            todo += near
        if len(now) > 1:
            tables.append(sorted(now))
    return sorted(tables)


def found(spark, rows):
    out = {}
    for r in grids.table_cells(drawn(spark, rows), ["page"]).collect():
        out.setdefault(r.page, {}).setdefault(r.table_id, []).append((r.box.x0, r.box.y0, r.box.x1, r.box.y1))
    return {p: sorted(sorted(t) for t in ts.values()) for p, ts in out.items()}


def test_random_grids_against_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for page in range(12):
        levels, uprights = [], []
        for left in (0, 1000):  # one or two tables a page, with missing rules
            n, m = rng.randrange(2, 7), rng.randrange(2, 6)
            ys, xs = [100 + 40 * i for i in range(n + 1)], [left + 50 + 70 * i for i in range(m + 1)]
            keep = lambda k, last: k in (0, last) or rng.random() < 0.75
            for i, y in enumerate(ys):
                gone = [j for j in range(m) if not keep(i, n)]
                start = None
                for j in range(m + 1):
                    here = j < m and j not in gone
                    if here and start is None:
                        start = xs[j]
                    if not here and start is not None:
                        levels.append((y, start, xs[j]))
                        start = None
            for j, x in enumerate(xs):
                gone = [i for i in range(n) if not keep(j, m)]
                start = None
                for i in range(n + 1):
                    here = i < n and i not in gone
                    if here and start is None:
                        start = ys[i]
                    if not here and start is not None:
                        uprights.append((x, start, ys[i]))
                        start = None
        want[page] = brute(levels, uprights)
        for y, a, b in levels:
            cut = rng.randrange(a, b)
            rows += [(page, "line", a, y, cut, y), (page, "line", cut - 2, y, b, y)]  # two strokes of one rule
        rows += [(page, "line", x, c, x, d) for x, c, d in uprights]
    got = found(spark, rows)
    for p, ts in want.items():
        a, b = {c for t in ts for c in t}, {c for t in got.get(p, []) for c in t}
        assert a == b, (p, a - b, b - a, levels, uprights)
    assert got == {p: [[tuple(map(float, c)) for c in t] for t in ts] for p, ts in want.items() if ts}


def test_strokes_boxes_and_dangling_rules(spark):
    full = [(1, "rect", 50 + 70 * j, 100 + 30 * i, 120 + 70 * j, 130 + 30 * i) for i in range(3) for j in range(4)]
    page2 = [(2, k, a, b + 0.8, c, d + 0.8) for _, k, a, b, c, d in full[:6]] + [(2, k, a, b, c, d) for _, k, a, b, c, d in full[:8]]
    dangling = [(1, "line", 80, 105, 80, 125), (1, "line", 150, 110, 150, 150), (1, "line", 0, 500, 400, 500), (3, "rect", 10, 10, 60, 60), (3, "line", 0, 0, 100, 90), (1, "line", 55, 101, 56, 101)]
    got = grids.table_cells(drawn(spark, full + page2 + dangling), ["page"])
    shape = {(r.page, r.table_id): (r.n_rows, r.n_cols, r.n_cells) for r in grids.regions(got, ["page"]).collect()}
    assert shape == {(1, 0): (3, 4, 12), (2, 0): (2, 4, 8)}  # a single box is no table
    assert [(r.row, r.col) for r in got.filter("page = 1").orderBy("row", "col").collect()] == [(i, j) for i in range(3) for j in range(4)]


def test_merged_cells_keep_their_place(spark):
    # the second row's first two cells are one
    lines = [(1, "line", 0, y, 90, y) for y in (0, 20, 40, 60)] + [(1, "line", x, 0, x, 60) for x in (0, 60, 90)] + [(1, "line", 30, 0, 30, 20), (1, "line", 30, 40, 30, 60)]
    got = {(r.row, r.col): (r.box.x0, r.box.x1) for r in grids.table_cells(drawn(spark, lines), ["page"]).collect()}
    assert got == {(0, 0): (0, 30), (0, 1): (30, 60), (0, 2): (60, 90), (1, 0): (0, 60), (1, 2): (60, 90), (2, 0): (0, 30), (2, 1): (30, 60), (2, 2): (60, 90)}


def test_no_drawings(spark):
    assert grids.table_cells(drawn(spark, []), ["page"]).collect() == []
    assert grids.regions(grids.table_cells(drawn(spark, [(1, "line", 0, 0, 50, 0)]), ["page"]), ["page"]).select(F.col("page")).collect() == []


def test_pages_that_hang_together_by_corners_only_beside_plain_ones(spark):
    steps = [(1, "rect", 40 * i, 40 * i, 40 * i + 40, 40 * i + 40) for i in range(5)]
    plain = [(2, "rect", 40 * i, 30 * j, 40 * i + 40, 30 * j + 30) for i in range(3) for j in range(2)]
    got = sorted((r.page, r.table_id, r.row, r.col) for r in grids.table_cells(drawn(spark, steps + plain), ["page"]).collect())
    assert got == [(1, 0, i, i) for i in range(5)] + [(2, 0, j, i) for j in range(2) for i in range(3)]


def test_drawings_dealt_by_page_are_not_shuffled_again(spark, monkeypatch):
    """Plain pages: neither crossings nor cells are written or dealt anew; only the pages that are odd would be."""
    written = []
    monkeypatch.setattr(grids.components, "_written", lambda df: written.append(df) or df)
    rows = [(p, "rect", 40 * i, 30 * j, 40 * i + 40, 30 * j + 30) for p in range(3) for i in range(3) for j in range(2)]
    got = grids.table_cells(drawn(spark, rows).repartition(4, "page"), ["page"])
    assert [df.columns for df in written] == [["page"]]
    for df in (got, written[0]):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert got.count() == 18


def test_no_task_draws_more_than_so_many_items(spark, monkeypatch):
    from docforge.plans import extraction

    monkeypatch.setattr(extraction, "ITEMS", 60)
    assert extraction._drawings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 90


def test_windows_along_one_edge_share_a_sort(spark):
    got = grids.table_cells(drawn(spark, [(1, "rect", 0, 0, 40, 30), (1, "rect", 40, 0, 80, 30)]).repartition(4, "page"), ["page"])
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # no lists by two-step aggregation, which sorts and writes them anew, and fewer sorts than windows
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert plan.count("Sort [") <= 17 < plan.count("Window ["), (plan.count("Sort ["), plan.count("Window ["))
