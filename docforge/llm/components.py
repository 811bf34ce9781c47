"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_small, looked_up


def contracted(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, label: each identifier that occurs in links, and the smallest identifier of its component.

    Each round a node takes the smallest neighbour below it as its parent, parents are followed up to their roots, and links
    are redrawn between roots; links within a root go. The labels are the parents of all rounds, one after the other.
    The rounds grow with the logarithm of a component's width. Each is written to the shared folder; the driver learns
    only how many links are left. A root may have a third of all links: it is looked up without gathering them.
    """
    x, y = F.greatest(a, b), F.least(a, b)
    edges, n = cut_small(links.select(x.alias("x"), y.alias("y")).filter("x <> y").distinct())
    nodes, roots = edges.select(F.explode(F.array("x", "y")).alias("id")).distinct(), []
    while n:
        up, n_up = cut_small(edges.groupBy("x").agg(F.min("y").alias("root")))
        while True:
            above = up.select(F.col("x").alias("root"), F.col("root").alias("above"))
            step, _ = cut_small(looked_up(up, above, "root", "x", "left", n=n_up).select("x", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            up = step.select("x", "root")
            if not step.filter("moved").limit(1).count():
                break
        roots.append((up, n_up))
        low = looked_up(edges, up, "x", "y", n=n_up).select("x", "y", "root")
        both = looked_up(low, up.select(F.col("x").alias("y"), F.col("root").alias("other")), "y", "x", "left", n=n_up).select(F.col("root").alias("x"), F.coalesce("other", "y").alias("y"))
        edges, n = cut_small(both.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    labels = nodes.withColumn("label", F.col("id"))
    for up, n_up in roots:
        labels = looked_up(labels, up.select(F.col("x").alias("label"), "root"), "label", "id", "left", n=n_up).select("id", F.coalesce("root", "label").alias("label"))
    return cut_small(labels)[0]
