from pyspark.sql import functions as F

from docforge.llm.components import contracted


def bits(df):
    """Bits of the size in bytes that Spark estimates for df."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size.bit_length() if isinstance(size, int) else size.bitLength()


def test_estimated_sizes_do_not_grow_with_rounds(spark):
    links, known = spark.range(2000).select(F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(2000)).alias("b")).filter("a <> b"), None
    for turn in range(3):
        some = links.filter(F.pmod("a", F.lit(3)) == turn)
        known = contracted(some if known is None else some.unionByName(known.select(F.col("id").alias("a"), F.col("label").alias("b"))))
        assert bits(known) < 64
    label = {r.id: r.label for r in known.collect()}
    assert all(label[r.a] == label[r.b] <= min(r.a, r.b) for r in links.collect())
