"""A line through points of which some lie off it: the best of a bounded number of pairs, then least squares through those that agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of points that are tried for each line. With half of the points on the line one pair in four lies on it: 64 pairs miss it once in 10^8 lines.
TRIALS = 64
#: Steps that spread the pairs over the points, and the seed.
STEPS, SEED = (7919, 104_729), 42


def _sums(points: Column, keep) -> Column:
    """n, sx, sy, sxx, sxy of the points that keep takes, from the first point's place, so that the sums lose no digits."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")))
    x0, y0 = points[0]["x"], points[0]["y"]

    def step(a: Column, p: Column) -> Column:
        x, y = p["x"] - x0, p["y"] - y0
        more = F.struct((a["n"] + 1).alias("n"), (a["x"] + x).alias("x"), (a["y"] + y).alias("y"), (a["xx"] + x * x).alias("xx"), (a["xy"] + x * y).alias("xy"))
        return F.when(keep(p), more).otherwise(a)

    return F.aggregate(points, zero, step)


def ransac_lines(points: DataFrame, by: list[str], threshold: str, x: str = "x", y: str = "y", trials: int = TRIALS) -> DataFrame:
    """by, slope, intercept, n (points), inliers, inlier_std: the line of each group's points.

    A hypothesis is a line through two points (of different x) that a fixed rule picks by number; what lies within the group's `threshold` (a column, the same
    in each row) of it agrees. The one with the most, then the least sum of squares, then the first, is fitted anew through those that agree.
    Of 64 pairs and n points that takes 64 n steps, in one aggregation by group: groups are the glyphs of a text line.
    Groups of fewer than two different x have no line. Nulls are left out. Fixed rule and seed: the same points have the same line in any order.
    """
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    lists = p.groupBy(*by).agg(F.array_sort(F.collect_list(at)).alias("p"), F.max(threshold).cast("double").alias("t"), F.count("*").alias("n")).filter("n > 1")

    def hypothesis(h: Column) -> Column:
        i = F.pmod(h * STEPS[0] + SEED, F.col("n"))
        j = F.pmod(i + 1 + F.pmod(h * STEPS[1] + SEED, F.col("n") - 1), F.col("n"))
        a, b = F.get("p", i.cast("int")), F.get("p", j.cast("int"))
        slope = F.when(a["x"] != b["x"], (b["y"] - a["y"]) / (b["x"] - a["x"]))
        return F.struct(h.alias("h"), slope.alias("s"), (a["y"] - slope * a["x"]).alias("c"))

    tried = lists.withColumn("hs", F.filter(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), hypothesis), lambda h: h["s"].isNotNull()))

    def score(h: Column) -> Column:
        off = lambda q: q["y"] - (h["s"] * q["x"] + h["c"])
        zero = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("q"))
        step = lambda a, q: F.when(F.abs(off(q)) <= F.col("t"), F.struct((a["k"] + 1).alias("k"), (a["q"] + off(q) * off(q)).alias("q"))).otherwise(a)
        return F.aggregate("p", zero, step, lambda a: F.struct((-a["k"]).alias("k"), a["q"].alias("q"), h["h"].alias("h"), h["s"].alias("s"), h["c"].alias("c")))

    best = tried.filter(F.size("hs") > 0).select(*by, "p", "t", "n", F.array_min(F.transform("hs", score)).alias("b"))
    near = lambda q: F.abs(q["y"] - (F.col("b.s") * q["x"] + F.col("b.c"))) <= F.col("t")
    summed = best.select(*by, "p", "n", "b", "t", _sums(F.col("p"), near).alias("z"))
    z = F.col("z")
    spread = z["n"] * z["xx"] - z["x"] * z["x"]
    slope = F.when(spread > 0, (z["n"] * z["xy"] - z["x"] * z["y"]) / spread).otherwise(F.col("b.s"))
    fitted = summed.withColumn("slope", slope)
    fitted = fitted.withColumn("intercept", F.col("p")[0]["y"] + (z["y"] - F.col("slope") * z["x"]) / z["n"] - F.col("slope") * F.col("p")[0]["x"])
    off = lambda q: q["y"] - (F.col("slope") * q["x"] + F.col("intercept"))
    squares = F.aggregate("p", F.lit(0.0), lambda a, q: F.when(near(q), a + off(q) * off(q)).otherwise(a))
    # residuals of a least-squares line have mean 0
    return fitted.select(*by, "slope", "intercept", "n", z["n"].cast("long").alias("inliers"), F.sqrt(squares / z["n"]).alias("inlier_std"))


def baseline_outliers(glyphs: DataFrame, by: list[str], least: int = 4, confident: float = 0.8, residual: float = 0.05, most_z: float = 2.0, least_off: float = 1.5, least_share: float = 0.03) -> DataFrame:
    """Glyphs (x, bottom, height, class, confidence, char_confidence) that stand off their line, with expected, residual, uncertainty, z, anomaly_confidence and the line.

    The line is fitted through the reliable glyphs whose two confidences multiply to more than `confident`; `least` of them and two that agree are needed. What
    agrees lies within a twentieth of their median height, one pixel at least. Uncertainty is the largest of 1.5 pixels, 3 % of that height and twice
    the deviation of those that agree; off are glyphs by more than two of it. Letters with descenders may hang lower, excluded glyphs are passed over.
    """
    sure = glyphs.filter((F.col("class") == "reliable") & (F.col("confidence") * F.col("char_confidence") > confident))
    heights = sure.groupBy(*by).agg(F.count("*").alias("anchors"), F.median("height").alias("median_height")).filter(F.col("anchors") >= least)
    anchored = sure.join(heights, by).withColumn("_t", F.greatest(F.lit(1.0), F.col("median_height") * residual))
    lines = ransac_lines(anchored, by, "_t", "x", "bottom").drop("n").filter("inliers >= 2")
    met = glyphs.join(lines.join(heights, by), by)
    off = met.withColumn("expected", F.col("slope") * F.col("x") + F.col("intercept")).withColumn("residual", F.col("bottom") - F.col("expected"))
    off = off.withColumn("uncertainty", F.greatest(F.lit(least_off), F.col("median_height") * least_share, F.col("inlier_std") * 2))
    z = off.withColumn("z", F.abs("residual") / F.col("uncertainty")).filter((F.col("z") > most_z) & (F.col("class") != "excluded") & ~((F.col("class") == "uncertain") & (F.col("residual") > 0)))
    return z.withColumn("anomaly_confidence", F.when(F.col("char_confidence") > 0.8, 0.75).otherwise(0.5))
