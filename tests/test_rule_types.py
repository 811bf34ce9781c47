"""How results of rules meet the types of documents."""

from pyspark.sql import functions as F

from docforge.operators import rules


def test_no_task_has_the_results_of_more_than_so_many_documents(spark, monkeypatch, capsys):
    monkeypatch.setattr(rules, "DOCUMENTS", 10)
    day = F.lit("2024-01-10").cast("date")
    wide = spark.range(930).select(F.col("id").alias("doc_id"), day.alias("VALID_FROM"), F.date_add(day, (F.col("id") % 3 - 1).cast("int")).alias("VALID_UNTIL"))
    types = wide.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "certificate").otherwise("resume").alias("document_type"))
    found = rules.run_rules({"wide": wide, "documents": types}, {"certificate.window"})
    assert {(int(r.doc_id), r.status) for r in found.collect()} == {(n, "failed" if n % 3 == 0 else "passed") for n in range(0, 930, 2)}
    found.explain()
    assert ", 93)" in capsys.readouterr().out
