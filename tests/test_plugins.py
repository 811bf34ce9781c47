import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docforge.operators import ledger, plugins
from docforge.sources import registry
from docforge.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "doc_id long, row_idx long, ts timestamp, flow_in double, flow_out double, balance double"


def test_registry_snapshots_with_filters_pushed(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"source": "SC", "companies": [{"name": "Beta Sdn Bhd"}, {"name": ""}, {"company_name": " Alpha "}, "x"]}))
    (tmp_path / "b.json").write_text(json.dumps({"source": "BNM", "data": [{"company_name": "Alpha Scam", "url": "http://a", "date": "2024-01-01"}]}))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "ignored.txt").write_text("no")
    registry.register(spark)
    d = spark.read.format("registry_snapshot").option("path", str(tmp_path)).load()
    assert [(r.file, r.ord, r.name) for r in d.orderBy("file", "ord").collect()] == [("a.json", 0, "Beta Sdn Bhd"), ("a.json", 2, " Alpha "), ("a.json", 3, "x"), ("b.json", 0, "Alpha Scam")]
    some = d.filter(F.col("name_lower").startswith("alpha") & (F.col("source") == "BNM") & (F.length("name") > 3))
    some.explain()
    plan = capsys.readouterr().out
    assert "StartsWith" not in plan.split("BatchScan")[0] and "length" in plan.split("BatchScan")[0]
    assert [(r.name, r.url) for r in some.collect()] == [("Alpha Scam", "http://a")]
    assert d.filter(F.col("name_lower").isin("alpha", "x")).count() == 2 and d.filter("name_lower = 'nobody'").count() == 0
    assert spark.read.format("registry_snapshot").option("path", f"file://{tmp_path}/b.json").load().count() == 1


def test_a_rule_called_from_sql_states_its_columns(spark):
    def rising(row, before):
        if before is not None and row.day < before.day:
            yield (before.day, row.day)

    plugins.register(spark, plugins.Plugin("bank.days_rise", "before int, day int", "doc_id", "row_idx", rising))
    rows = [("a", 2, 5), ("a", 0, 1), ("a", 1, 7), ("b", 0, 9), ("b", 1, 9), (None, 0, 3), (None, 1, 2)]
    spark.createDataFrame(rows, "doc_id string, row_idx int, day int").repartition(4).createOrReplaceTempView("plugin_rows")
    out = spark.sql("SELECT * FROM bank_days_rise(TABLE(plugin_rows))")
    assert out.columns == ["doc_id", "rule_name", "before", "day"]
    assert {tuple(r) for r in out.collect()} == {("a", "bank.days_rise", 7, 5), (None, "bank.days_rise", 3, 2)}
    with pytest.raises(Exception, match="needs the columns row_idx"):
        spark.sql("SELECT * FROM bank_days_rise(TABLE(SELECT doc_id FROM plugin_rows))").collect()


def test_late_disordered_and_restarted_input_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    first = [(1, 1, t(1), 5.0, None, 5.0), (1, 0, t(0), None, None, 0.0), (1, 3, t(3), 1.0, None, 9.0), (2, 0, t(0), None, None, 1.0)]
    second = [(1, 2, t(2), 2.0, None, 7.0), (1, 4, t(4), None, 4.0, 5.0), (2, 1, t(5), 1.0, None, None), (2, 2, t(6), 1.0, None, 3.0), (9, 0, t(600), None, None, 0.0)]
    third, fourth = [(1, 5, t(650), 1.0, None, 6.0), (1, 6, t(2), 1.0, None, 7.0), (9, 1, t(1200), None, None, 0.0)], [(9, 2, t(2400), None, None, 0.0)]

    def run(n):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = stateful.ledger_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(150)
        assert not q.isActive and q.exception() is None

    try:
        for n, rows in enumerate((first, second, third, fourth)):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            if n in (1, 3):  # stopped and started again in between
                run(n)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.doc_id, r.row_idx, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.doc_id != 9}
    kept = [r for r in first + second + third if r[0] != 9 and r[:2] != (1, 6)]  # row 6 comes after the watermark has passed it
    money = spark.createDataFrame([(d, 0, i, a, b, c) for d, i, _, a, b, c in kept], "doc_id long, table_ord int, row_idx long, flow_in double, flow_out double, balance double")
    money = money.select("doc_id", "table_ord", "row_idx", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("flow_in", "flow_out", "balance")))
    want = {(r.doc_id, r.row_idx, r.state.lower()) for r in ledger.running_balance(money).collect()}
    assert got == want
