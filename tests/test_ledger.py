"""The worked bank statement: twelve rows with planted errors, ten results."""

from pyspark.sql import functions as F

from docforge.functions.dates import iso_date
from docforge.functions.values import to_decimal
from docforge.operators import ledger
from docforge.operators.results import confidence

ROWS = [
    (0, "2023-11-24", None, None, "0.57"), (1, "2023-11-25", None, "2212.14", "2212.71"), (2, "2023-11-26", "60.00", None, "152.71"), (3, "2023-11-27", "30.50", None, "122.71"),
    (4, "2023-12-28", None, "425.23", None), (5, "2023-11-29", None, "500.00", None), (6, None, "202.34", None, "27.76"), (7, None, "15.13", None, "27.76"),
    (8, "2023-12-30", "28.90", None, "1.53"), (9, "2023-12-01", None, None, "17.27"), (10, "2023-12-02", "1.00", None, "10.27"), (11, None, None, None, "2139.27"),
]


def bank(spark):
    raw = spark.createDataFrame([("d", 0, *r, None) for r in ROWS], "doc_id string, table_ord int, row_idx int, date string, o string, i string, b string, s string")
    return raw.select("doc_id", "table_ord", "row_idx", iso_date(F.col("date")).alias("event_date"), to_decimal(F.col("o")).alias("flow_out"), to_decimal(F.col("i")).alias("flow_in"), to_decimal(F.col("b")).alias("balance"), to_decimal(F.col("s")).alias("flow_signed"))


def wide(spark):
    return spark.sql("SELECT 'd' AS doc_id, 0.57BD AS OPENING_BALANCE, 2139.27BD AS CLOSING_BALANCE, DATE'2023-11-25' AS PERIOD_START, DATE'2023-12-02' AS PERIOD_END")


def test_running_balance_islands(spark):
    got = {(r.status, r.row_index, r.last_row, r.n_rows, None if r.delta is None else float(r.delta)) for r in ledger.balance_results(bank(spark)).collect()}
    assert got == {("failed", 2, 3, 2, 2000.5), ("failed", 7, 11, 5, 2168.54), ("incomplete", 4, 6, 3, None)}


def test_opening_closing_and_sum(spark):
    got = {r.rule_name: (r.status, r.delta) for r in ledger.table_results(bank(spark), wide(spark)).collect()}
    assert got["bank.opening_matches_first_row"][0] == got["bank.closing_matches_last_row"][0] == "passed"
    assert got["bank.sum_flow_matches_balance_change"][0] == "failed" and float(got["bank.sum_flow_matches_balance_change"][1]) == 660.8


def test_period_and_chronology(spark):
    assert {r.row_idx for r in ledger.outside_period(bank(spark), wide(spark)).collect()} == {4, 8}
    assert {(r.row_idx, r.up) for r in ledger.chronology(bank(spark)).collect()} == {(5, True), (9, True)}


def test_a_right_ledger_never_fails_and_one_wrong_row_shows_twice(spark):
    rows = spark.range(200).select((F.col("id") % 4).alias("doc_id"), F.lit(0).alias("table_ord"), F.floor(F.col("id") / 4).cast("int").alias("row_idx"), F.lit("2.5").cast("decimal(18,6)").alias("flow_in"), F.lit(None).cast("decimal(18,6)").alias("flow_out"))
    good = rows.withColumn("balance", ((F.col("row_idx") + 1) * 2.5).cast("decimal(18,6)"))
    assert ledger.balance_results(good).count() == 0
    bad = good.withColumn("balance", F.when((F.col("doc_id") == 1) & (F.col("row_idx") == 20), F.col("balance") + 1).otherwise(F.col("balance")).cast("decimal(18,6)"))
    assert [(r.doc_id, r.row_index, r.n_rows) for r in ledger.balance_results(bad).collect()] == [(1, 20, 2)]


def test_confidence_ladder(spark):
    cases = [("x.benford", None, None, None, 0.55), ("x.date_rule", None, None, "9", 0.9), ("bank.running_balance_recursion", "1", "2", "1", 0.75), ("a", None, None, None, 0.9), ("a", "1", "1", "0.005", 0.5), ("a", "100", "90", "10", 0.9), ("a", "1000", "999", "1", 0.75), ("a", "100000", "99999", "1", 0.55)]
    df = spark.createDataFrame([c for c in cases], "r string, e string, a string, d string, want double")
    assert all(x.got == x.want for x in df.withColumn("got", confidence(F.col("r"), F.col("e"), F.col("a"), F.col("d"))).collect())
