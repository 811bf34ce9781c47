import numpy as np
from pyspark.sql import functions as F

from docforge.functions import geometry as g
from docforge.operators import masks


def flood(mask, threshold, least):
    on, seen, out = mask > threshold, set(), []
    for start in zip(*map(list, np.nonzero(on))):
        start = tuple(map(int, start))
        if start in seen:
            continue
        todo, own = [start], []
        seen.add(start)
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and on[n] and n not in seen:
                    seen.add(n)
                    todo.append(n)
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        area = (max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1)
        if area >= least:
            out.append((min(xs), min(ys), max(xs), max(ys), area, len(own), round(float(np.mean([mask[p] for p in own])), 6)))
    return sorted(out)


def test_regions_against_a_flood_fill(spark):
    rng = np.random.default_rng(3)
    pages = {p: rng.random((40, 150)) for p in range(3)}
    spiral = np.zeros((41, 41))
    for k in range(0, 20, 2):  # one region of many turns
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = 0.9
        spiral[k + 2 : 41 - k, k] = 0.9
        spiral[k + 2, k : k + 3] = 0.9
    pages |= {3: spiral, 4: np.zeros((5, 5)), 5: np.ones((30, 90))}
    rows = [(p, y, [float(v) for v in line]) for p, m in pages.items() for y, line in enumerate(m)] + [(6, 0, []), (6, 1, None)]
    d = spark.createDataFrame(rows, "page int, y int, scores array<double>").repartition(3)
    got = masks.regions(masks.runs(d, ["page"], 0.45), ["page"], 4)
    have = {}
    for r in got.collect():
        have.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1, r.area, r.n, round(r.confidence, 6)))
    assert {p: sorted(v) for p, v in have.items()} == {p: w for p, m in pages.items() if (w := flood(m, 0.45, 4))}


def test_null_scores_count_as_off(spark):
    d = spark.createDataFrame([(1, 0, [0.9, None, 0.9, 0.9])], "page int, y int, scores array<double>")
    assert [(r.x0, r.x1, r.n) for r in masks.runs(d, ["page"]).orderBy("x0").collect()] == [(0, 0, 1), (2, 3, 2)]


def test_affine(spark):
    r = spark.range(1).select(g.box(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("b"))
    some, none = F.array(*(F.lit(float(v)) for v in (2, 0, 5, 0, 3, 7))), F.lit(None).cast("array<double>")
    got = r.select(masks.to_user(F.col("b"), some).alias("a"), masks.to_user(F.col("b"), none).alias("n")).first()
    assert tuple(got.a) == (7, 13, 11, 19) and tuple(got.n) == (1, 2, 3, 4)


def test_density_crop(spark):
    rows = [("m", 0, 10, 40, 16, [0, 1, 4, 9, 3, 0]), ("1", 0, 10, 4, 16, [0, 1, 0, 1, 0, 0]), ("l", 0, 10, 4, 16, [0.0] * 6), ("w", 5, 10, 5, 16, [9.0] * 6), ("W", 0, 0, 100, 5, [4, 5, 4, 6, 4]), ("", 0, 0, 10, 3, [1, 2, 1])]
    d = spark.createDataFrame([(c, *map(float, b), [float(v) for v in s]) for c, *b, s in rows], "c string, x0 double, y0 double, x1 double, y1 double, s array<double>")
    got = d.select("c", masks.density_crop(g.box("x0", "y0", "x1", "y1"), F.col("s"), F.col("c")).alias("b")).collect()
    assert {r.c: (r.b.y0, r.b.y1) for r in got} == {"m": (12, 14), "1": (11, 14), "l": (10, 16), "w": (10, 16), "W": (1, 4), "": (1, 2)}


def test_runs_of_a_row_of_any_width(spark):
    import random
    import time

    rng = random.Random(3)
    rows = [[rng.choice((0.1, 0.6, 0.9, None)) for _ in range(n)] for n in (1, 2, 7, 60, 60)] + [[], None, [0.9, 0.9], [0.1], [0.7] + [0.2] * 20_000 + [0.8]]
    want = set()
    for y, row in enumerate(rows):
        on = [False, *(x is not None and x > 0.5 for x in row or []), False]
        starts, ends = ([i for i in range(1, len(on)) if on[i - a] != on[i - b] and on[i - b]] for a, b in ((1, 0), (0, 1)))
        want |= {(y, a - 1, b - 2) for a, b in zip(starts, ends)}
    began = time.time()
    got = {(r.y, r.x0, r.x1) for r in masks.runs(spark.createDataFrame(list(enumerate(rows)), "y int, scores array<double>").withColumn("p", F.lit(1)), ["p"]).collect()}
    assert got == want
    assert time.time() - began < 20  # marks told anew for each pixel are the square of a row's width
