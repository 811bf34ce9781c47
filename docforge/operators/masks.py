"""Connected regions of score masks, over runs of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import components, joins

#: A pixel counts if its score is above the first; a region if its box has as many pixels as the second.
THRESHOLD = 0.5
LEAST_AREA = 100


def runs(rows: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """by, y, x0, x1 (inclusive), n, total (of the scores): the unbroken runs of pixels above the threshold.

    rows: by, y, scores (an array, one row of a mask). Runs are told within each row, without a shuffle.
    """
    on = lambda x: F.coalesce(x > threshold, F.lit(False))

    def found(s: Column) -> Column:
        # each pixel beside the one before it, and one step past the last: no mark is looked up from within a lambda, which would tell all marks anew
        marks, none = F.transform(s, on), F.array(F.lit(False))
        turns = F.zip_with(F.concat(none, marks), F.concat(marks, none), lambda before, now: now.cast("int") - before.cast("int"))
        at = lambda turn, back: F.array_compact(F.transform(turns, lambda t, i: F.when(t == turn, i - back)))
        return F.zip_with(at(1, 0), at(-1, 1), lambda a, b: F.struct(a.alias("x0"), b.alias("x1")))

    each = rows.select(*by, "y", "scores", F.explode(found(F.col("scores"))).alias("r"))
    length = F.col("r.x1") - F.col("r.x0") + 1
    total = F.aggregate(F.slice("scores", F.col("r.x0") + 1, length), F.lit(0.0), lambda a, x: a + x)
    return each.select(*by, "y", F.col("r.x0").alias("x0"), F.col("r.x1").alias("x1"), length.cast("long").alias("n"), total.alias("total"))


def regions(found: DataFrame, by: list[str], least_area: int = LEAST_AREA) -> DataFrame:
    """by, region (its first run's y and x0), x0, y0, x1, y1 (inclusive), area (of the box), n (pixels), confidence (their mean score).

    Pixels touch by their sides, hence runs of neighbouring rows that share a column do; runs of one row don't, so that a run has no more
    links than there are runs above and below it. A region of any height takes as many rounds as its height has binary digits, about.
    """
    kept = components._written(found)
    span = lambda name: g.box("x0", F.lit(0), "x1", F.lit(0)).alias(name)
    upper = kept.select(*by, (F.col("y") + 1).alias("_y"), F.col("x0").alias("_from"), F.col("x1").alias("_to"), span("box"))
    lower = kept.select(*by, F.col("y").alias("_y"), F.col("x0").alias("_low"), F.col("x1").alias("_high"), span("other"))
    pairs = joins.box_pairs(upper, lower, [*by, "_y"], (F.col("_from") <= F.col("_high")) & (F.col("_low") <= F.col("_to")))
    node = lambda y, x: F.struct(*by, y.alias("y"), x.alias("x0"))
    label = components.connected(pairs.select(node(F.col("_y") - 1, F.col("_from")).alias("a"), node(F.col("_y"), F.col("_low")).alias("b")))
    label = label.select("id.*", F.struct(F.col("label.y").alias("y"), F.col("label.x0").alias("x0")).alias("region"))
    of = kept.join(label, [*by, "y", "x0"], "left").withColumn("region", F.coalesce("region", F.struct("y", "x0")))
    box = of.groupBy(*by, "region").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    area = (F.col("x1") - F.col("x0") + 1).cast("long") * (F.col("y1") - F.col("y0") + 1)
    return box.withColumn("area", area).filter(F.col("area") >= least_area).withColumn("confidence", F.col("total") / F.col("n")).drop("total")


def to_user(box: Column, transform: Column) -> Column:
    """A box of pixels in page units, by transform (a, b, c, d, e, f): x * a + c, y * e + f; without one as it is."""
    x = lambda v: F.coalesce(v * transform[0] + transform[2], v.cast("double"))
    y = lambda v: F.coalesce(v * transform[4] + transform[5], v.cast("double"))
    return g.box(x(box["x0"]), y(box["y0"]), x(box["x1"]), y(box["y1"]))


#: Characters so narrow that a single pixel of ink a row is enough.
NARROW = "1Il|i:;.,'"


def density_crop(box: Column, sums: Column, char: Column) -> Column:
    """A character's box (whole pixels, y1 exclusive) cut to its rows from the first to the last with enough ink, unchanged without one.

    sums: ink of each of its rows, from y0 on, in pixels. Enough is a tenth of the width, between 2 and 5 pixels; one for narrow characters.
    """
    w = box["x1"] - box["x0"]
    least = F.when(F.contains(F.lit(NARROW), char) & (F.length(char) == 1), F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0), w * 0.1), F.lit(5.0)))
    inside = F.slice(sums, 1, F.greatest(box["y1"] - box["y0"], F.lit(0)).cast("int"))
    enough = F.transform(inside, lambda s: s >= least)
    first, last = F.array_position(enough, F.lit(True)), F.array_position(F.reverse(enough), F.lit(True))
    cut = F.struct(box["x0"].alias("x0"), (box["y0"] + first - 1).cast("double").alias("y0"), box["x1"].alias("x1"), (box["y0"] + F.size(inside) - last + 1).cast("double").alias("y1"))
    return F.when((w > 0) & (first > 0), cut).otherwise(box)
