"""Exact dedup by a tree of merges over sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salt

#: What is deleted before texts are compared.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, rounds: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are dealt to fan_in ** rounds leaves by their identifier. Each leaf sorts and pre-aggregates its digests to
    a run with the best identifier and the count of each. In round t, the fan_in runs whose numbers differ in digit t
    exchange: each receives the digests whose own digit t names it, and merges the sorted runs. After the last round
    a run holds all that there is of its digests, so no run grows to the whole corpus and no digest is in two.
    The results go back along the same leaves: a digest has one row a leaf at most, however many copies there are.

    Merging is by the whole SHA-256 of the normalised text, never by a prefix of it, so that each level's
    smallest identifier is verified. Of equal texts the longest original stays, then the smallest identifier.
    A null text counts as empty. A null identifier comes after all others. Where an identifier repeats with an equal
    text, each row counts in group_size and each is kept if the identifier is. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    leaves = fan_in**rounds
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
        .select("doc_id", "chars", F.unhex(F.sha2("norm", 256)).alias("digest"), salt(F.col("doc_id"), leaves).alias("leaf"))
    )
    better = F.struct((-F.col("chars")).alias("order"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    runs = level = rows.groupBy("leaf", "digest").agg(F.min(better).alias("best"), F.count("*").alias("n")).withColumnRenamed("leaf", "run")
    for t in range(rounds):
        width = fan_in**t
        mine = (F.col("run") / width).cast("int") % fan_in
        to = F.pmod((F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") / width).cast("long"), F.lit(fan_in)).cast("int")
        level = level.withColumn("run", F.col("run") + (to - mine) * width).groupBy("run", "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    merged = level.select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    back = runs.select(F.col("run").alias("leaf"), "digest").join(merged, "digest")
    return rows.join(back, ["leaf", "digest"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
