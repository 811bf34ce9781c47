"""Classes of alike rows among those that share a bucket: every pair of a bucket is told alike or not, those within one class excepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_small, looked_up, tidy
from .components import contracted

#: Rows of a bucket that one task compares with as many others at a time.
BLOCK = 500


def classes(
    members: DataFrame,
    own: DataFrame,
    verified: Callable[[DataFrame, DataFrame], DataFrame],
    near: Callable[[Column, Column], Column],
) -> DataFrame | None:
    """id, label: each x that is alike to another, and the smallest x of its class; None if no two are alike.

    members has x and key; own has, once for each x, the struct `own` from which `near` tells cheaply that two rows can't be alike; `verified` gets
    pairs (x, center) and all x of shared buckets, and gives the pairs that are alike.

    1. Each row of a bucket is paired with the bucket's smallest x, and the classes of what is alike are found. Most buckets are of
       one class then, and nothing more is done with them.
    2. In the other buckets all pairs of rows of different classes are compared (`_across`): by `near` in the tasks that join them, and what it
       leaves is verified. So the classes are those of all pairs that share a key, however large a bucket is.

    The second step takes the square of a bucket in comparisons, but not in a task's memory, and what it leaves is verified in rounds of a bounded size.
    """
    # one shuffle of all members: a bucket lies in one task, sorted and spilled, but is a small part of them, as each x has many keys
    bucket = Window.partitionBy("key")
    shared = members.select("key", "x", F.min("x").over(bucket).alias("a"), F.max("x").over(bucket).alias("b"), F.count("*").over(bucket).alias("n"))
    rows, _ = cut_small(shared.filter("a <> b").drop("b"))
    star, n = cut_small(rows.filter("x <> a").select("x", F.col("a").alias("center")).distinct())
    if not n:
        return None
    everyone = cut(star.select("x").union(star.select("center")).distinct())

    def linked(pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """The classes, drawn anew with those of the pairs that are alike."""
        links, n_links = cut_small(verified(pairs, everyone).select("x", "center"))
        if not n_links:
            return labels
        known = links if labels is None else links.unionByName(labels.filter("id <> label").select(F.col("id").alias("x"), F.col("label").alias("center")))
        return contracted(known, "x", "center")

    # large tables on either side: merged, with hot centers split where they are found
    both = star.join(own.hint("merge"), "x").withColumnRenamed("own", "own_x").join(own.withColumnRenamed("x", "center").hint("merge"), "center")
    tried, n_tried = cut_small(both.filter(near(F.col("own_x"), F.col("own"))).select("x", "center"))
    labels = linked(tried, None) if n_tried else None
    tidy(members.sparkSession)
    across = _across(rows.filter("n > 2"), labels, own, near)  # those of two rows are compared
    if across is None:
        return labels
    rest, n_rest = cut_small(across.join(tried, ["x", "center"], "left_anti"))
    # verifying brings texts to each pair: so in rounds of no more pairs than there are rows, each without those that were linked meanwhile
    rounds = -(-n_rest // everyone.count())
    for turn in range(rounds):
        tidy(members.sparkSession)
        now = rest.filter(F.pmod(F.xxhash64("center"), F.lit(rounds)) == turn)
        labels = linked(now if labels is None else _apart(now, labels), labels)
    tidy(members.sparkSession)
    return labels


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (x, center) of two classes."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    met = pairs.join(of("x"), "x", "left").join(of("center"), "center", "left")
    return met.filter(F.coalesce("label_x", "x") != F.coalesce("label_center", "center")).select("x", "center")


def _across(rows: DataFrame, labels: DataFrame | None, own: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame | None:
    """All pairs (x, center), x the larger, of rows of different classes in one bucket that `near` leaves; None without any such bucket.

    A bucket is dealt to blocks of some BLOCK rows, and each two of its blocks meet in a join of their own: so a row is copied once for each block of its
    bucket, and no task holds more of a bucket than two blocks.
    """
    by = rows.select("key", "x")
    by = by.withColumn("label", F.col("x")) if labels is None else by.join(labels.withColumnRenamed("id", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    by = cut(by)
    live, n = cut_small(by.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n"))
    if not n:
        return None
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = looked_up(by, live, "key", "x", n=n).select("key", "x", "label", parts.alias("parts"), F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"))
    open_ = cut(open_.join(own.hint("merge"), "x"))
    spark = rows.sparkSession
    # few bytes, but much to compare: as many tasks as there are cores or shuffle partitions, and not as the bytes would have it
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = open_.select("key", "x", "label", "own", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    high = open_.select("key", F.col("x").alias("y"), F.col("label").alias("other"), F.col("own").alias("own_y"), F.col("part").alias("j"), F.explode(F.sequence(F.lit(0), "part")).alias("i"))
    low, high = low.repartition(tasks, "key", "i", "j").alias("low"), high.repartition(tasks, "key", "i", "j").hint("merge").alias("high")
    at = [F.col(f"low.{c}") == F.col(f"high.{c}") for c in ("key", "i", "j")]
    on = at[0] & at[1] & at[2] & (F.col("label") != F.col("other")) & ((F.col("low.i") != F.col("low.j")) | (F.col("x") > F.col("y"))) & near(F.col("own"), F.col("own_y"))
    return low.join(high, on).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("center")).distinct()
