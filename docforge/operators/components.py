"""Clusters of linked items, and what is reachable from a root."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names; only a session on one machine may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docforge-"))
    return df.checkpoint(eager=True)


#: Links that a round holds at most for their least neighbours to be broadcast; with more, links are dealt to salts.
MOST_BROADCAST = 300_000
SALTS = 32


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """links (u, v) with m, the least v of its u. A u that holds a third of all links is summed before it is shuffled, and its links meet m in SALTS tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if n <= MOST_BROADCAST:
        return links.join(F.broadcast(least), "u")
    salted = links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return salted.join(salted.select("u", "_salt").distinct().join(least, "u"), ["u", "_salt"]).drop("_salt")


def _unfinished(now: DataFrame, odd: DataFrame, n_odd: int) -> DataFrame:
    """links (u, v) with busy: whether their cluster has an item of odd (id, n_odd rows).

    Items that aren't odd are leaves of one link or have no smaller neighbour: so a cluster with an odd item has one at v, or beside v, for each of its links.
    """
    small = n_odd <= MOST_BROADCAST
    sent = F.broadcast if small else lambda d: d.hint("merge")
    beside = now.join(sent(odd.withColumnRenamed("id", "u")), "u", "left_semi").select("v")
    busy = odd.withColumnRenamed("id", "v").unionByName(beside).distinct().withColumn("busy", F.lit(True))
    if small:
        return now.join(F.broadcast(busy), "v", "left").select("u", "v", F.col("busy").isNotNull().alias("busy"))
    salted = now.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    met = salted.select("v", "_salt").distinct().join(busy, "v")
    return salted.join(met, ["v", "_salt"], "left").select("u", "v", F.col("busy").isNotNull().alias("busy"))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, label: the smallest identifier of each linked item's cluster.

    Stars by turns: each item's larger neighbours are linked to its least one, then all its smaller neighbours and itself are, until every
    item is linked to its label alone. Rounds grow with the logarithm of a cluster's size, whatever its shape; the driver sees two counts a round.
    A cluster that is such a star is laid aside, so that later rounds have the links of the others alone.
    """
    known = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    known = _written(known.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    now = known.filter("u <> v")
    n = now.count()
    done = now.select("u", "v").limit(0)
    while n:
        sides = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        large = _written(_with_least(sides.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), n))
        small = large.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = _written(small.unionByName(large.select("u", F.col("m").alias("v"))).distinct())
        # stars: each item has one smaller neighbour at most, and none if it has larger ones
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("k")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("k")))
        told = ends.groupBy("id").agg(F.sum("k").alias("up"), F.min("k").alias("down"))
        odd = _written(told.filter("up > 1 or up = 1 and down = 0").select("id"))
        n_odd = odd.count()
        if not n_odd:
            break
        marked = _written(_unfinished(now, odd, n_odd))
        done = done.unionByName(marked.filter("not busy").drop("busy"))
        now = marked.filter("busy").drop("busy")
        n = now.count()
    now = done.unionByName(now)
    every = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    for c in (now.select("v"), known.filter("u = v").select("v")):
        every = every.unionByName(c.select(F.col("v").alias("id"), F.col("v").alias("label")))
    return every.groupBy("id").agg(F.min("label").alias("label"))


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """nodes (by, id) that no path of edges (by, src, dst) leads to from roots: breadth first, a level a round."""
    seen = edge = _written(roots.select(*by, "id").distinct())
    while edge.limit(1).count():
        step = edge.join(edges.withColumnRenamed("src", "id"), [*by, "id"]).select(*by, F.col("dst").alias("id")).distinct()
        edge = _written(step.join(seen, [*by, "id"], "left_anti"))
        seen = _written(seen.unionByName(edge))
    return nodes.join(seen, [*by, "id"], "left_anti")
