"""Boxes (x0, y0, x1, y1 from the top left) as Column expressions. Each takes two structs or aliases' columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    names = ("x0", "y0", "x1", "y1")
    return F.struct(*((F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), names)))


def width(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0))


def height(a: Column) -> Column:
    return F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def area(a: Column) -> Column:
    return width(a) * height(a)


def center_x(a: Column) -> Column:
    return (a["x0"] + a["x1"]) / 2


def center_y(a: Column) -> Column:
    return (a["y0"] + a["y1"]) / 2


def aspect(a: Column) -> Column:
    return F.try_divide(width(a), height(a))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def coverage(inner: Column, outer: Column) -> Column:
    """The share of inner that outer covers."""
    return F.coalesce(F.try_divide(intersection(inner, outer), area(inner)), F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def center_in(a: Column, b: Column) -> Column:
    return center_x(a).between(b["x0"], b["x1"]) & center_y(a).between(b["y0"], b["y1"])


def union_of(a: Column) -> Column:
    """Aggregate: the smallest box around a group's boxes."""
    return F.struct(F.min(a["x0"]).alias("x0"), F.min(a["y0"]).alias("y0"), F.max(a["x1"]).alias("x1"), F.max(a["y1"]).alias("y1"))


def to_pixels(a: Column, scale: Column) -> Column:
    return F.struct(*((a[n] * scale).alias(n) for n in ("x0", "y0", "x1", "y1")))


def cells(a: Column, size: float = 64.0) -> Column:
    """Numbers of the grid cells that a box touches, for joins of boxes by cell."""
    n = lambda v: F.floor(v / size).cast("int")
    xs, ys = F.sequence(n(a["x0"]), n(F.greatest(a["x0"], a["x1"]))), F.sequence(n(a["y0"]), n(F.greatest(a["y0"], a["y1"])))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
