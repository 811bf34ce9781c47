"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir names it. Only a session on one machine, as in tests, may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docforge-"))
    return sc.getCheckpointDir()


#: Rows that a partition of an intermediate table has at least, so that late rounds of a loop don't write a file for each of many empty partitions.
LEAST_ROWS = 10_000


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, so that lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame) -> tuple[DataFrame, int]:
    """cut, with the number of rows; tables that are small for their number of partitions get fewer.

    A checkpoint keeps the size that its plan was estimated at, and each join multiplies its sides': over the rounds of a loop that becomes a number
    of hundreds of megabytes in the driver. So the rows are cached until they are written, as the plan of a filled cache has the size that it measured.
    """
    held = df.persist()
    n = held.count()
    df = cut(held.select("*"))
    held.unpersist()
    return df.coalesce(n // LEAST_ROWS + 1), n


def tidy(spark: SparkSession) -> None:
    """Between rounds: collects the driver's garbage, on which Spark's cleaner drops shuffles, broadcasts and checkpoint files that no table needs any more."""
    spark.sparkContext._jvm.System.gc()


def release(known: dict | None = None) -> None:
    """At a task's end: what a Python worker remembers would else stay in its memory, idle or busy with other stages."""
    import pyarrow as pa

    if known is not None:
        known.clear()
    pa.default_memory_pool().release_unused()


def salt(by: Column, n: int) -> Column:
    """A number under n that spreads the rows of one key evenly; a null gets one, too."""
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")


def spread_lookup(rows: DataFrame, values: DataFrame, key: str, by: str, n: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with values (one row a key) on key, where a key may hold a third of all rows.

    Each key's rows are dealt to n salts by the column `by`. The pairs of key and salt that occur are
    joined to the values first (n rows a key at most), and rows then meet theirs on key and salt.
    """
    salted = rows.withColumn("_salt", salt(F.col(by), n))
    met = salted.select(key, "_salt").groupBy(key, "_salt").agg(F.lit(1).alias("_one")).drop("_one").join(values, key)
    return salted.join(met, [key, "_salt"], how).drop("_salt")


#: Rows of a table of two or three numbers that is sent to all executors at most; the rows are counted first, larger tables are met by a shuffle.
#: A plan may have a dozen of them, which the driver builds at once: so few that all are some megabytes.
MOST_BROADCAST = 20_000


def looked_up(rows: DataFrame, values: DataFrame, key: str, by: str, how: str = "inner", most: int = MOST_BROADCAST, n: int | None = None) -> DataFrame:
    """rows joined with values (few rows a key) on key, without a task that gets all rows of a key.

    values are counted (n: their rows, where they are known) and broadcast where they are at most `most`; else rows are dealt to salts (`spread_lookup`).
    """
    if (values.count() if n is None else n) <= most:
        return rows.join(F.broadcast(values), key, how)
    return spread_lookup(rows, values, key, by, how=how)
