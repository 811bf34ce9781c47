import datetime as dt

from docforge.streaming import incremental as I

SCHEMA = "doc_id long, row_idx long, ts timestamp, flow_in double, flow_out double, balance double"


def test_ledger_in_order_of_rows(spark, tmp_path):
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    first = [(1, 1, t(1), 5.0, None, 5.0), (1, 0, t(0), None, None, 0.0), (1, 3, t(3), 1.0, None, 9.0)]
    second = [(1, 2, t(2), 2.0, None, 7.0), (1, 4, t(4), None, 4.0, 5.0), (9, 0, t(600), None, None, 0.0)]
    third = [(9, 1, t(1200), None, None, 0.0)]
    for n, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = I.ledger_check(stream).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.row_idx, r.state) for r in spark.sql("SELECT * FROM ledger WHERE doc_id = 1").collect()}
    assert got == {(1, "passed"), (2, "passed"), (3, "failed"), (4, "passed")}


def test_batches_and_distinct(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "fp string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("fp string, ts timestamp").parquet(f"{tmp_path}/in")
    I.each_batch(I.distinct_evidence(stream), lambda df: df, f"{tmp_path}/out", f"{tmp_path}/c", ["fp"]).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
