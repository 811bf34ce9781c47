"""Robust statistics and outlier tests by group. Medians are exact; groups are gated by size before the costly passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import _written
from .joins import small

#: Dixon's critical values for 3 to 10 values; Benford's zones of the mean absolute deviation.
DIXON = {3: 0.970, 4: 0.829, 5: 0.710, 6: 0.628, 7: 0.569, 8: 0.608, 9: 0.564, 10: 0.530}
BENFORD_ZONES, BENFORD_LEAST = (0.006, 0.012), 30


#: Values of a group that one task may sort; larger groups are enclosed by a sketch first. Both ways are exact.
MOST_SORTED = 100_000


def _same(by: list[str], mark: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"{mark}{i}")) for i, b in enumerate(by)))


def _marked(groups: DataFrame, by: list[str], mark: str, *more: str) -> DataFrame:
    return groups.select(*(F.col(b).alias(f"{mark}{i}") for i, b in enumerate(by)), *more)


def _enclosed_median(plain: DataFrame, by: list[str], accuracy: int = 1000) -> DataFrame:
    """by, n, median of the column _v, however large the groups: no task holds a whole group's values.

    A sketch of bounded size gives two values that enclose the middle. Values below the first are counted only; those between (a few
    in a thousand) are counted by value, and a running sum over them finds the middle ones exactly.
    """
    ends = F.percentile_approx("_v", [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)
    bounds = plain.groupBy(*by).agg(F.count("*").alias("n"), ends.alias("_e")).withColumn("_lo", F.col("_e")[0]).withColumn("_hi", F.col("_e")[1])
    near = plain.join(small(_marked(bounds, by, "_b", "n", "_lo", "_hi")), _same(by, "_b")).filter("_v <= _hi")
    counts = near.groupBy(*by, "n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    middle = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_v")))
    found = counts.withColumn("_upto", upto).groupBy(*by, "n").agg(middle(F.expr("(n - 1) div 2 + 1")).alias("_a"), middle(F.expr("n div 2 + 1")).alias("_z"))
    return found.select(*by, "n", ((F.col("_a") + F.col("_z")) / 2).alias("median"))


def medians(rows: DataFrame, by: list[str], value: str, most_sorted: int = MOST_SORTED) -> DataFrame:
    """by, n, median (the mean of the two middle values) and mad (the median of the distances from it) of each group; null values are left out, a null key is a group.

    Groups are counted first. Those of most_sorted values or fewer are sorted whole, in one aggregation; the others by bounds from a sketch, without a task that holds them.
    """
    plain = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    large = _marked(plain.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > most_sorted), by, "_g")
    any_large = bool(large.limit(1).count())
    usual = plain.join(small(large), _same(by, "_g"), "left_anti") if any_large else plain
    middle = lambda v: (F.get(v, F.expr("cast((n - 1) div 2 AS int)")) + F.get(v, F.expr("cast(n div 2 AS int)"))) / 2
    lists = usual.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_v")).alias("_s")).withColumn("median", middle(F.col("_s")))
    out = lists.withColumn("_d", F.array_sort(F.transform("_s", lambda x: F.abs(x - F.col("median"))))).select(*by, "n", "median", middle(F.col("_d")).alias("mad"))
    if not any_large:
        return out
    own = plain.join(small(large), _same(by, "_g"), "left_semi")
    mid = _enclosed_median(own, by)
    off = own.join(small(_marked(mid, by, "_m", "median")), _same(by, "_m")).select(*by, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    mad = _marked(_enclosed_median(off, by).withColumnRenamed("median", "mad"), by, "_d", "mad")
    return out.unionByName(mid.join(mad, _same(by, "_d")).select(*by, "n", "median", "mad"))


def exact_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return medians(rows, by, value).drop("mad")


def with_mad(rows: DataFrame, by: list[str], value: str, least: int = 1, floor: float = 0.5) -> DataFrame:
    """rows with n, median, mad and modified z = 0.6745 |x - median| / max(mad, floor); groups under `least` rows are left out, a null key is a group."""
    known = _written(_marked(medians(rows, by, value).filter(F.col("n") >= least), by, "_k", "n", "median", "mad"))
    met = rows.join(small(known), _same(by, "_k")).drop(*(f"_k{i}" for i in range(len(by))))
    return met.withColumn("z", F.lit(0.6745) * F.abs(F.col(value) - F.col("median")) / F.greatest(F.col("mad"), F.lit(floor)))


def cv(value: Column) -> Column:
    return F.try_divide(F.stddev_pop(value), F.avg(value))


def benford(rows: DataFrame, by: list[str], digit: str, least: int = BENFORD_LEAST) -> DataFrame:
    """n, mad and zone (close, acceptable, failed) of the first digits of each group of `least` values."""
    counts = [F.count_if(F.col(digit) == d) for d in range(1, 10)]
    n = F.count(digit)
    mad = sum((F.abs(c / n - F.log10(F.lit(1 + 1 / d))) for d, c in enumerate(counts, 1)), F.lit(0.0)) / 9
    out = rows.groupBy(*by).agg(n.alias("n"), mad.alias("mad")).filter(F.col("n") >= least)
    return out.withColumn("zone", F.when(F.col("mad") < BENFORD_ZONES[0], "close").when(F.col("mad") < BENFORD_ZONES[1], "acceptable").otherwise("failed"))


def dixon(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups of 3 to 10 values with q_low, q_high and whether the extremes are outliers. Q10 to seven values, Q11 from eight."""
    g = rows.groupBy(*by).agg(F.count(value).alias("n")).filter(F.col("n").between(3, 10))
    w = rows.join(g, by).groupBy(*by).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda i: F.element_at("v", i)
    eleven = F.col("n") >= 8
    low = F.try_divide(at(2) - at(1), F.when(eleven, at(-2)).otherwise(at(-1)) - at(1))
    high = F.try_divide(at(-1) - at(-2), at(-1) - F.when(eleven, at(2)).otherwise(at(1)))
    crit = F.create_map(*(F.lit(x) for kv in DIXON.items() for x in kv))[F.col("n").cast("int")]
    out = w.select(*by, "n", F.coalesce(low, F.lit(0.0)).alias("q_low"), F.coalesce(high, F.lit(0.0)).alias("q_high"), crit.alias("critical"))
    return out.withColumn("low_is_outlier", F.col("q_low") > F.col("critical")).withColumn("high_is_outlier", F.col("q_high") > F.col("critical"))


def tabular_groups(rows: DataFrame, by: list[str], value: str, least: int = 5, most_cv: float = 0.01) -> DataFrame:
    """n, mean and whether all values may be taken as one width (five values, variation under 1 %)."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), cv(F.col(value)).alias("cv"))
    return out.withColumn("tabular", (F.col("n") >= least) & (F.col("cv") < most_cv))


def histogram(rows: DataFrame, by: list[str], key: str, weight: Column) -> DataFrame:
    """weight by key, its share of the group, and the rank of the first appearance is left to the caller."""
    h = rows.groupBy(*by, key).agg(F.sum(weight).alias("weight"))
    return h.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)))


def coverage(rows: DataFrame, by: list[str], key: str, chars: str, page: str) -> DataFrame:
    """Each key of a group with n_chars, coverage (percent of the group's characters, two places), its pages in order, and its place, fullest first."""
    n = rows.groupBy(*by, key).agg(F.sum(chars).alias("n_chars"), F.array_sort(F.collect_set(page)).alias("pages"))
    whole = Window.partitionBy(*by)
    out = n.withColumn("coverage", F.round(F.try_divide(F.col("n_chars") * 100.0, F.sum("n_chars").over(whole)), 2))
    return out.withColumn("place", F.row_number().over(whole.orderBy(F.desc("n_chars"), key)))


def dominant(rows: DataFrame, by: list[str], key: str, weight: Column, order: str) -> DataFrame:
    """The heaviest key of each group; of equal ones the one that appears first."""
    h = rows.groupBy(*by, key).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return h.groupBy(*by).agg(F.max_by(key, F.struct("w", (-F.col("o")).alias("o"))).alias(key), F.max("w").alias("weight"))


def rare_bars(bars: DataFrame, by: list[str], count: str, k: float = 3.5, least_bars: int = 3, least_total: int = 30, least_bar: int = 2) -> DataFrame:
    """Bars whose log count lies below median - k max(MAD, 0.1) / 0.6745 of their group's (bars of least_bar, groups by the gates)."""
    w = Window.partitionBy(*by)
    gated = bars.filter(F.col(count) >= least_bar).withColumn("_n", F.count("*").over(w)).withColumn("_t", F.sum(count).over(w)).filter((F.col("_n") >= least_bars) & (F.col("_t") >= least_total))
    scored = with_mad(gated.withColumn("_log", F.ln(count)), by, "_log", floor=0.1)
    limit = F.col("median") - F.lit(k) * F.greatest(F.col("mad"), F.lit(0.1)) / 0.6745
    return scored.withColumn("rare", F.col("_log") < limit).drop("_n", "_t", "_log", "z")


def scoped(rows: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Each row once for every scope, so that one pass tests them all."""
    each = F.array(*(F.struct(F.lit(name).alias("scope"), c.cast("string").alias("scope_id")) for name, c in scopes.items()))
    return rows.select("*", F.explode(each).alias("_s")).select(*rows.columns, "_s.scope", "_s.scope_id")


def merge_scopes(hits: DataFrame, by: list[str], base: float = 0.7, bonus: float = 0.15, allowed: Column | None = None, allowed_confidence: float = 0.3) -> DataFrame:
    """A row for each item with its scopes in order and confidence base + bonus for each further scope, 1 at most."""
    out = hits.groupBy(*by).agg(F.array_sort(F.collect_set("scope")).alias("scopes"))
    conf = F.least(F.lit(1.0), F.lit(base) + (F.size("scopes") - 1) * F.lit(bonus))
    return out.withColumn("confidence", F.when(allowed, F.lit(allowed_confidence)).otherwise(conf) if allowed is not None else conf)


def best_axis(rows: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """axis and mad of the column with the smallest deviation (of equal ones the first listed)."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for i, a in enumerate(axes)))).alias("x")).select(*by, "x.*")
    mads = medians(long, [*by, "axis", "i"], "v")
    return mads.groupBy(*by).agg(F.min_by("axis", F.struct("mad", "i")).alias("axis"), F.min("mad").alias("mad"))


def forgive_headers(hits: DataFrame, by: list[str], row: str, column: str, rows_to: int = 1, least: int = 2) -> DataFrame:
    """Outliers but those of the first rows that show in `least` columns at once: they are headers."""
    n = F.size(F.collect_set(column).over(Window.partitionBy(*by, row)))
    return hits.withColumn("_n", n).filter(~((F.col(row) <= rows_to) & (F.col("_n") >= least))).drop("_n")


def robust_line(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Slope and intercept of each group's line by the median of all pairs' slopes. Groups are the glyphs of one text line."""
    a = points.select(*by, F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = points.select(*by, F.col(x).alias("xb"), F.col(y).alias("yb"))
    slopes = a.join(b, by).filter("xa < xb").groupBy(*by).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"))
    j = points.join(slopes, by)
    return j.groupBy(*by).agg(F.first("slope").alias("slope"), F.median(F.col(y) - F.col("slope") * F.col(x)).alias("intercept"), F.count("*").alias("n"))


def half_width(bins: DataFrame, by: list[str]) -> DataFrame:
    """bins (bin, n): width in bins of the run around the highest bin in which n is at least half of it."""
    w = Window.partitionBy(*by)
    top = bins.withColumn("top", F.max("n").over(w)).withColumn("at", F.min_by("bin", F.struct((-F.col("n")).alias("n"), "bin")).over(w))
    high = top.filter(F.col("n") * 2 >= F.col("top")).withColumn("island", F.col("bin") - F.row_number().over(Window.partitionBy(*by).orderBy("bin")))
    return high.groupBy(*by, "island").agg(F.count("*").alias("width"), F.max(F.col("bin") == F.col("at")).alias("peak")).filter("peak").select(*by, "width")


def rare_styles(spans: DataFrame, by: list[str], style: list[str], chars: str, share: float = 0.02, least_chars: int = 30) -> DataFrame:
    """Each style of a document with n_spans, n_chars, its share, and whether it is rare: under 2 % of the characters, or under 30 of them. Heaviest first in `place`."""
    n = spans.groupBy(*by, *style).agg(F.count("*").alias("n_spans"), F.sum(chars).alias("n_chars"))
    whole = Window.partitionBy(*by)
    out = n.withColumn("share", F.try_divide(F.col("n_chars"), F.sum("n_chars").over(whole)))
    out = out.withColumn("rare", (F.col("share") < share) | (F.col("n_chars") < least_chars))
    return out.withColumn("place", F.row_number().over(whole.orderBy(F.desc("n_chars"), *style)))


def rarest(spans: DataFrame, by: list[str], style: list[str], text: str, order: str, bins: int = 10, keep: int = 10) -> DataFrame:
    """The `bins` rarest styles of each document (fewest characters first), each with its `keep` shortest spans: bin, item, text."""
    chars = F.length(text)
    n = spans.groupBy(*by, *style).agg(F.sum(chars).alias("n_chars"))
    top = n.withColumn("bin", F.row_number().over(Window.partitionBy(*by).orderBy("n_chars", *style))).filter(F.col("bin") <= bins)
    met = spans.join(top, [*by, *style])
    item = F.row_number().over(Window.partitionBy(*by, "bin").orderBy(chars, order))
    return met.withColumn("item", item).filter(F.col("item") <= keep).select(*by, *style, "n_chars", "bin", "item", order, text)


def top_sizes(images: DataFrame, by: list[str], width: str = "width", height: str = "height", keep: int = 10) -> DataFrame:
    """The `keep` most frequent sizes of images of each document, with their numbers; of equal ones the smaller."""
    n = images.groupBy(*by, width, height).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), width, height))).filter(F.col("place") <= keep)


def duplicate_groups(objects: DataFrame, by: list[str], key: str, order: str, groups: int = 20, members: int = 10) -> DataFrame:
    """The `groups` largest groups of objects of the same content in each document, their first `members` in order, and whether any were left out."""
    first = objects.withColumn("_i", F.row_number().over(Window.partitionBy(*by, key).orderBy(order)))
    g = first.groupBy(*by, key).agg(F.max("_i").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_i") <= members, F.col(order)))).alias("members")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))
    return g.withColumn("place", place).filter(F.col("place") <= groups).withColumn("truncated", F.col("n") > members)


def fragmentation(lines: DataFrame, by: list[str], spans: str, chars: str, least: int = 5, limit: float = 3.5) -> DataFrame:
    """Lines whose average span is much shorter than the document's: modified z of the log of characters by span, lines of `least` spans only."""
    log = F.log1p(F.try_divide(F.col(chars).cast("double"), F.col(spans)))
    z = with_mad(lines.withColumn("log_length", log).filter(F.col("log_length").isNotNull()), by, "log_length", floor=0.05)
    return z.withColumn("fragmented", (F.col(spans) >= least) & (F.col("log_length") < F.col("median")) & (F.col("z") > limit))
