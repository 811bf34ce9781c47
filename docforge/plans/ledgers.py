"""Account statements made of events: one ledger a user, balances as sums with every 97th row off by 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledger
from ..operators.results import status_counts, to_evidence
from .base import query, table

M = "decimal(18,6)"


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(18,2)").cast(M))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    inflow = F.col("event_type").isin("purchase", "signup")
    e = e.withColumn("row_idx", F.row_number().over(w) - 1).withColumn("flow_in", F.when(inflow, F.col("v"))).withColumn("flow_out", F.when(~inflow, F.col("v")))
    signed = F.coalesce("flow_in", F.lit(0).cast(M)) - F.coalesce("flow_out", F.lit(0).cast(M))
    true = F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(M)
    off = F.when(F.col("event_id") % 97 == 0, F.lit("5").cast(M)).otherwise(F.lit("0").cast(M))
    balance = F.when(F.col("event_id") % 89 != 0, (true + off).cast(M))
    flow_signed = F.when(F.col("event_id") % 53 == 0, -signed).otherwise(signed).cast(M)
    return e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("table_ord"), "row_idx", F.to_date("ts").alias("event_date"), "flow_in", "flow_out", flow_signed.alias("flow_signed"), balance.alias("balance"), "event_id")


ROWS = """
e AS (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS v, event_type IN ('purchase', 'signup') AS is_in FROM events),
s AS (SELECT user_id AS doc_id, row_number() OVER w - 1 AS row_idx, CAST(ts AS DATE) AS event_date, CASE WHEN is_in THEN v END AS flow_in, CASE WHEN NOT is_in THEN v END AS flow_out,
  CASE WHEN is_in THEN v ELSE -v END AS signed, sum(CASE WHEN is_in THEN v ELSE -v END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS true_balance, event_id
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bank AS (SELECT doc_id, row_idx, event_date, flow_in, flow_out, CASE WHEN event_id % 53 = 0 THEN -signed ELSE signed END AS flow_signed,
  CASE WHEN event_id % 89 <> 0 THEN true_balance + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END END AS balance, event_id FROM s)"""

CHECKED = f"""WITH {ROWS},
l AS (SELECT *, lag(balance) OVER w + coalesce(flow_in, 0) - coalesce(flow_out, 0) AS expected, row_number() OVER w AS rn FROM bank WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx)),
c AS (SELECT *, abs(expected - balance) AS delta, CASE WHEN expected IS NULL OR balance IS NULL THEN 'incomplete' WHEN abs(expected - balance) > 0.01 THEN 'failed' ELSE 'passed' END AS state FROM l WHERE rn > 1)"""


@query(f"{CHECKED} SELECT doc_id, row_idx, CAST(expected AS DECIMAL(18,2)) AS expected, CAST(balance AS DECIMAL(18,2)) AS balance, CAST(delta AS DECIMAL(18,2)) AS delta, state FROM c")
def ledger_running_balance(spark, sf_dir):
    d = lambda c: F.col(c).cast("decimal(18,2)").alias(c)
    return ledger.running_balance(bank_rows(spark, sf_dir)).select("doc_id", "row_idx", d("expected"), d("balance"), d("delta"), "state")


@query(f"""{CHECKED},
i AS (SELECT *, row_idx - row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS island FROM c WHERE state = 'failed')
SELECT doc_id, 'failed' AS status, min(row_idx) AS row_index, max(row_idx) AS last_row, count(*) AS n_rows, CAST(sum(delta) AS DECIMAL(28,6)) AS delta FROM i GROUP BY doc_id, island
UNION ALL SELECT doc_id, 'incomplete', min(row_idx), max(row_idx), count(*), NULL FROM c WHERE state = 'incomplete' GROUP BY doc_id""")
def ledger_islands(spark, sf_dir):
    return ledger.balance_results(bank_rows(spark, sf_dir)).select("doc_id", "status", "row_index", "last_row", "n_rows", "delta")


def declared(rows: DataFrame) -> DataFrame:
    """Opening balance 0; the closing one is the sum of all flows, 3 more for every seventh document."""
    total = F.sum(F.coalesce("flow_in", F.lit(0).cast(M)) - F.coalesce("flow_out", F.lit(0).cast(M)))
    return rows.groupBy("doc_id").agg(total.alias("_t")).select("doc_id", F.lit("0").cast(M).alias("OPENING_BALANCE"), (F.col("_t") + F.when(F.col("doc_id") % 7 == 0, F.lit(3)).otherwise(F.lit(0))).cast(M).alias("CLOSING_BALANCE"))


ENDS = f"""WITH {ROWS},
t AS (SELECT doc_id, sum(coalesce(flow_in, 0)) AS tin, sum(coalesce(flow_out, 0)) AS tout, arg_min(coalesce(flow_in, 0), row_idx) AS fin, arg_min(coalesce(flow_out, 0), row_idx) AS fout,
  arg_min(struct_pack(v := balance), row_idx).v AS first, arg_max(struct_pack(v := balance), row_idx).v AS last FROM bank GROUP BY doc_id),
d AS (SELECT *, 0 AS opening, tin - tout + CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS closing FROM t)"""


@query(f"""{ENDS}
SELECT doc_id, 'bank.opening_matches_first_row' AS rule_name, CASE WHEN first IS NULL THEN 'incomplete' WHEN abs((CASE WHEN abs(opening - first) <= 0.01 THEN opening ELSE opening + fin - fout END) - first) <= 0.01 THEN 'passed' ELSE 'failed' END AS status FROM d
UNION ALL SELECT doc_id, 'bank.closing_matches_last_row', CASE WHEN last IS NULL THEN 'incomplete' WHEN abs(closing - last) <= 0.01 THEN 'passed' ELSE 'failed' END FROM d
UNION ALL SELECT doc_id, 'bank.sum_flow_matches_balance_change', CASE WHEN abs((tin - tout) - (closing - opening)) <= 0.01 THEN 'passed' ELSE 'failed' END FROM d""")
def opening_closing_sum_flow(spark, sf_dir):
    rows = bank_rows(spark, sf_dir)
    return ledger.table_results(rows, declared(rows)).select("doc_id", "rule_name", "status")


@query(f"""WITH {ROWS}
SELECT doc_id, row_idx AS row_index, 'bank.flow_signed_consistency' AS rule_name FROM bank WHERE coalesce(flow_in, 0) - coalesce(flow_out, 0) <> 0 AND sign(flow_signed) <> sign(coalesce(flow_in, 0) - coalesce(flow_out, 0))
UNION ALL SELECT doc_id, row_idx, 'bank.row_flow_exclusive' FROM bank WHERE abs(flow_in) > 0 AND abs(CASE WHEN event_id % 71 = 0 THEN flow_in ELSE flow_out END) > 0""")
def flow_sign_exclusive(spark, sf_dir):
    rows = bank_rows(spark, sf_dir).withColumn("flow_out2", F.when((F.col("event_id") % 71 == 0) & F.col("flow_in").isNotNull(), F.col("flow_in")).otherwise(F.col("flow_out")))
    signs = ledger.flow_results(rows).filter("rule_name = 'bank.flow_signed_consistency'")
    both = ledger.flow_results(rows.drop("flow_out").withColumnRenamed("flow_out2", "flow_out")).filter("rule_name = 'bank.row_flow_exclusive'")
    return signs.unionByName(both).select("doc_id", "row_index", "rule_name")


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 13 <> 0),
w AS (SELECT *, lag(d) OVER (PARTITION BY doc_id ORDER BY o_orderkey) AS before, arg_max(d, o_orderkey) OVER (PARTITION BY doc_id) >= arg_min(d, o_orderkey) OVER (PARTITION BY doc_id) AS up FROM o),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) AS n FROM w WHERE before IS NOT NULL AND CASE WHEN up THEN d < before ELSE d > before END)
SELECT doc_id, o_orderkey, before, d, up, n FROM v WHERE n <= 3""")
def chronology_monotonic(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.to_date("o_orderdate")).alias("d"))
    return ledger.chronology(o, ["doc_id"], "d", "o_orderkey")


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderdate AS DATE) AS event_date FROM orders),
p AS (SELECT doc_id, CAST(min(event_date) + INTERVAL 400 DAY AS DATE) AS a, CAST(max(event_date) - INTERVAL 400 DAY AS DATE) AS b FROM o GROUP BY doc_id)
SELECT o.doc_id, o_orderkey, event_date FROM o JOIN p USING (doc_id) WHERE NOT event_date BETWEEN a - INTERVAL 3 DAY AND b + INTERVAL 3 DAY""")
def period_contains(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.to_date("o_orderdate").alias("event_date"))
    p = o.groupBy("doc_id").agg(F.date_add(F.min("event_date"), 400).alias("PERIOD_START"), F.date_sub(F.max("event_date"), 400).alias("PERIOD_END"))
    return ledger.outside_period(o, p).select("doc_id", "o_orderkey", "event_date")


@query(f"{CHECKED} SELECT doc_id, count(*) FILTER (state = 'passed') AS n_passed, count(*) FILTER (state = 'failed') AS n_failed, 0 AS n_skipped, count(*) FILTER (state = 'incomplete') AS n_incomplete FROM c GROUP BY doc_id")
def status_counts_by_document(spark, sf_dir):
    rows = ledger.running_balance(bank_rows(spark, sf_dir)).withColumnRenamed("state", "status")
    return status_counts(rows, ["doc_id"])


@query(f"""{ENDS},
r AS (SELECT doc_id, closing AS expected, last AS actual, abs(closing - last) AS delta FROM d WHERE last IS NOT NULL AND abs(closing - last) > 0.01)
SELECT doc_id, 'RECONCILIATION_BALANCE_MISMATCH' AS type, CASE WHEN delta * 100 >= greatest(abs(expected), abs(actual), 1) THEN 0.9 WHEN delta * 1000 >= greatest(abs(expected), abs(actual), 1) THEN 0.75 ELSE 0.55 END AS confidence FROM r
UNION ALL SELECT doc_id, 'RECONCILIATION_BALANCE_MISMATCH', 0.75 FROM d WHERE abs((tin - tout) - (closing - opening)) > 0.01""")
def evidence_confidence(spark, sf_dir):
    rows = bank_rows(spark, sf_dir)
    results = ledger.table_results(rows, declared(rows)).filter("rule_name <> 'bank.opening_matches_first_row'")
    return to_evidence(results, ["doc_id"]).select("doc_id", "type", "confidence")
