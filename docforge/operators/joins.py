"""Joins beyond equality: versions in force, boxes, names by prefix and containment, best partner, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .components import _written

#: Rows that a small table has at most to be broadcast; larger ones are joined by shuffling.
MOST_BROADCAST = 100_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows are counted to be few enough, as a dimension's are; else left to the planner."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def spread(rows: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """rows dealt by their keys to a task for each core, and to as many as a shuffle has, at least: for costly work on few bytes, which adaptive execution would gather in one task.

    With `most`, rows are counted and dealt to so many tasks that each gets some `most` rows.
    """
    spark = rows.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(max(least, -(-rows.count() // most)) if most else least, *keys)


def intervals(versions: DataFrame, keys: list[str], since: str) -> DataFrame:
    """versions with valid_from and valid_to (exclusive, null for the latest)."""
    w = Window.partitionBy(*keys).orderBy(since)
    return versions.withColumn("valid_from", F.col(since)).withColumn("valid_to", F.lead(since).over(w)).withColumn("is_last", F.lead(since).over(w).isNull())


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, take: list[str]) -> DataFrame:
    """rows with the columns `take` of the version in force at the row's date; a null date takes the latest, a date before all none.

    Versions become intervals first, so that each row meets one of them: no ranking of pairs.
    """
    v = small(intervals(versions, keys, since).select(*(F.col(k).alias(f"_{k}") for k in keys), "valid_from", "valid_to", "is_last", *take))
    day = F.col(at)
    on = ((day >= F.col("valid_from")) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))) | (day.isNull() & F.col("is_last"))
    for k in keys:
        on = on & (rows[k] == F.col(f"_{k}"))
    return rows.join(v, on, "left").drop(*(f"_{k}" for k in keys), "valid_from", "valid_to", "is_last")


def box_pairs(boxes: DataFrame, others: DataFrame, by: list[str], on: Column, size: float = 64.0, box: str = "box", other: str = "other") -> DataFrame:
    """Pairs of boxes of the same page that share a grid cell and fulfil `on`; others' columns but `by` must have other names.

    Boxes meet in the cells that both touch, so that pages with many boxes are not compared pair by pair. A pair that
    shares several cells is taken in the first of them only (the largest of both boxes' first cells), which needs no distinct.
    """
    a = boxes.withColumn("_c", F.explode(g.cells(F.col(box), size)))
    b = others.withColumn("_d", F.explode(g.cells(F.col(other), size)))
    n = lambda v: F.floor(v / size).cast("int")
    met = a.withColumn("_k", F.col("_c")).join(b.withColumn("_k", F.col("_d")), [*by, "_k"])
    first = (F.col("_c.x") == F.greatest(n(F.col(f"{box}.x0")), n(F.col(f"{other}.x0")))) & (F.col("_c.y") == F.greatest(n(F.col(f"{box}.y0")), n(F.col(f"{other}.y0"))))
    return met.filter(first & on).drop("_c", "_d", "_k")


def assign_smallest(items: DataFrame, regions: DataFrame, by: list[str], least_iou: float = 0.3) -> DataFrame:
    """Each item with the smallest region (then the first) that has its centre or overlaps it by least_iou; null without one.

    items: item_id, box; regions: region_id, ord, other. The same as taking regions from the smallest up, greedily,
    as each item goes to the smallest region that would take it.
    """
    near = g.center_in(F.col("box"), F.col("other")) | (g.iou(F.col("box"), F.col("other")) >= least_iou)
    pairs = box_pairs(items, regions.select(*by, "region_id", "ord", "other"), by, near)
    best = pairs.groupBy(*by, "item_id").agg(F.min(F.struct(g.area(F.col("other")).alias("area"), "ord", "region_id"))["region_id"].alias("region_id"))
    return items.select(*by, "item_id").join(best, [*by, "item_id"], "left")


def assign_best_iou(items: DataFrame, cells: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """Each item with the cell that it overlaps best, by IoU of `least` or more; of equal ones the first."""
    pairs = box_pairs(items, cells.select(*by, "cell_id", "ord", "other"), by, g.iou(F.col("box"), F.col("other")) >= least)
    best = F.max(F.struct(g.iou(F.col("box"), F.col("other")).alias("iou"), (-F.col("ord")).alias("o"), "cell_id"))
    return pairs.groupBy(*by, "item_id").agg(best.alias("b")).select(*by, "item_id", F.col("b.cell_id").alias("cell_id"), F.col("b.iou").alias("iou"))


def center_then_iou(items: DataFrame, targets: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Each item with the first target that has its centre, else the best by IoU of `least`, else null (an orphan)."""
    box, other = F.col("box"), F.col("other")
    pairs = box_pairs(items, targets.select(*by, "target_id", "ord", "other"), by, g.center_in(box, other) | (g.iou(box, other) >= least))
    rank = F.struct((~g.center_in(box, other)).alias("miss"), F.when(g.center_in(box, other), F.lit(0.0)).otherwise(-g.iou(box, other)).alias("iou"), "ord", "target_id")
    best = pairs.groupBy(*by, "item_id").agg(F.min(rank)["target_id"].alias("target_id"))
    return items.select(*by, "item_id").join(best, [*by, "item_id"], "left")


def covered(items: DataFrame, by_boxes: DataFrame, by: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """(items that a box covers by `least` or more, those that none does)."""
    pairs = box_pairs(items, by_boxes.select(*by, "other"), by, g.coverage(F.col("box"), F.col("other")) >= least).select(*by, "item_id").distinct()
    return items.join(pairs, [*by, "item_id"], "left_semi"), items.join(pairs, [*by, "item_id"], "left_anti")


def greedy_pairs(left: DataFrame, right: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """One-to-one matches of both sides by IoU, and the rest of both: the best free pair of a page is taken first, then the next.

    In rounds: pairs that are the best left for both of their boxes are taken, by all pages at once, and the others of those boxes go. As the order (IoU, then
    identifiers) has no ties, these are the pairs that taking one after the other would take. A round takes one pair at least of each page that has any.
    """
    pairs = box_pairs(left, right.select(*by, F.col("item_id").alias("other_id"), F.col("box").alias("other")), by, g.iou(F.col("box"), F.col("other")) >= least)
    free = _written(pairs.select(*by, "item_id", "other_id", g.iou(F.col("box"), F.col("other")).alias("iou")))
    best = free.limit(0)
    order = F.struct((-F.col("iou")).alias("o"), "item_id", "other_id")
    top = lambda k: F.min(order).over(Window.partitionBy(*by, k))
    while free.limit(1).count():
        marked = free.withColumn("_a", top("item_id")).withColumn("_b", top("other_id"))
        taken = _written(marked.filter((F.col("_a") == order) & (F.col("_b") == order)).drop("_a", "_b"))
        best = best.unionByName(taken)
        gone = lambda k: taken.select(*by, k)  # noqa: E731, B023
        free = _written(free.join(gone("item_id"), [*by, "item_id"], "left_anti").join(gone("other_id"), [*by, "other_id"], "left_anti").select(*by, "item_id", "other_id", "iou"))
    alone = left.select(*by, "item_id").join(best, [*by, "item_id"], "left")
    rest = right.select(*by, F.col("item_id").alias("other_id")).join(best.select(*by, "other_id"), [*by, "other_id"], "left_anti")
    return alone.unionByName(rest, allowMissingColumns=True)


def name_lookup(rows: DataFrame, names: DataFrame, name: str = "name", least: int = 5) -> DataFrame:
    """rows with entry and match: the first entry (by ord) of the same normalised name; else the first of whose names
    one begins with the other, both of `least` characters; else null. names: normalized_name, entry, ord.

    Each name gives its beginnings of `least` characters and more, and these meet whole names by equality: rows grow with
    the lengths of names, however many of them begin alike.
    """
    first = names.groupBy(F.col("normalized_name").alias(name)).agg(F.min(F.struct("ord", "entry")).alias("e"))
    exact = rows.join(first, name, "left")
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(least), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    rest = exact.filter("e is null").select(name).distinct().filter(F.length(name) >= least)
    known = names.filter(F.length("normalized_name") >= least).groupBy("normalized_name").agg(F.min(F.struct("ord", "entry")).alias("e"))
    shorter = rest.select(name, starts(name).alias("normalized_name")).join(known, "normalized_name").select(name, "e")
    longer = known.select("e", starts("normalized_name").alias(name)).groupBy(name).agg(F.min("e").alias("e")).join(rest, name).select(name, "e")
    near = shorter.unionByName(longer).groupBy(name).agg(F.min("e").alias("near"))
    out = exact.join(near, name, "left")
    return out.select(*rows.columns, F.coalesce("e.entry", "near.entry").alias("entry"), F.when(F.col("e").isNotNull(), "EXACT_MATCH").when(F.col("near").isNotNull(), "FUZZY_MATCH").alias("match"))


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, longest: int = 8) -> DataFrame:
    """Pairs of distinct texts and patterns where the text contains the pattern; blank patterns are in none.

    They meet by equality: a pattern by its first `longest` characters (all, if it has fewer), a text by each of its
    stretches of so many; what meets by a longer pattern's beginning is looked at in full. No text meets all patterns.
    """
    t = texts.select(F.col(text)).filter(f"length({text}) > 0").distinct()
    p = patterns.select(F.col(pattern)).filter(f"length({pattern}) > 0").distinct()
    stretches = f"array_distinct(flatten(transform(sequence(1, least({longest}, length({text}))), k -> transform(sequence(1, length({text}) - k + 1), i -> substring({text}, i, k)))))"
    met = t.withColumn("_g", F.explode(F.expr(stretches))).join(p.withColumn("_g", F.substring(pattern, 1, longest)), "_g")
    return met.filter(F.contains(F.col(text), F.col(pattern))).select(text, pattern).distinct()


def listed(rows: DataFrame, alerts: DataFrame, allowed: DataFrame, name: str = "name") -> DataFrame:
    """outcome: alert if an alert's name contains the row's, else listed if an allowed name contains it or is contained, else null.

    Distinct names meet the lists once, by stretches of their characters (`containing`).
    """
    names, alerted, known = rows.select(name), alerts.select(F.col("name").alias("_a")), allowed.select(F.col("name").alias("_b"))
    a = containing(alerted, "_a", names, name).groupBy(name).agg(F.min("_a").alias("alert"))
    either = containing(known, "_b", names, name).select(name, "_b").unionByName(containing(names, name, known, "_b"))
    b = either.groupBy(name).agg(F.min("_b").alias("allowed"))
    out = rows.join(a, name, "left").join(b, name, "left")
    return out.withColumn("outcome", F.when(F.col("alert").isNotNull(), "alert").when(F.col("allowed").isNotNull(), "listed"))


def merge_by_priority(left: DataFrame, right: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """left with right's columns by the first key that matches, and the rows of right that none did (a full outer join by priority)."""
    out, used = left, []
    for i, k in enumerate(keys):
        r = right.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(F.struct("rid", *take)).alias(f"_m{i}"))
        out = out.join(r, out[k] == r["_k"], "left").drop("_k")
        used.append(F.col(f"_m{i}"))
    best = F.coalesce(*used)
    out = out.select(*left.columns, *(best[t].alias(t) for t in take), best["rid"].alias("rid"))
    rest = right.join(out.select("rid").distinct(), "rid", "left_anti").select(*(c for c in right.columns))
    return out.unionByName(rest, allowMissingColumns=True)


def split_known(rows: DataFrame, ids: str, known: DataFrame, by: list[str], known_id: str) -> DataFrame:
    """rows with valid and invalid: the listed identifiers that exist in known, and those that don't."""
    each = rows.select("row_id", *by, F.explode(ids).alias("_i"))
    found = each.join(known.select(*by, F.col(known_id).alias("_i")).distinct().withColumn("_there", F.lit(True)), [*by, "_i"], "left")
    there = F.col("_there").isNotNull()
    lists = found.groupBy("row_id").agg(F.array_sort(F.array_distinct(F.collect_list(F.when(there, F.col("_i"))))).alias("valid"), F.array_sort(F.array_distinct(F.collect_list(F.when(~there, F.col("_i"))))).alias("invalid"))
    empty = F.array().cast(dict(rows.dtypes)[ids])
    return rows.join(lists, "row_id", "left").withColumn("valid", F.coalesce("valid", empty)).withColumn("invalid", F.coalesce("invalid", empty))
