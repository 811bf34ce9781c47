"""Commercial documents made of orders and their lines, facts in long form, versions of rates, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, strings, values
from ..operators import joins, rules
from ..operators.results import emit
from .base import query, table

M = "decimal(18,6)"


def commercial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, discount and tax in money; the stated total is off by 1 on every third line number, missing where the part is a multiple of 50."""
    li = table(spark, sf_dir, "lineitem")
    price, qty = F.col("l_extendedprice").cast("decimal(18,2)").cast(M), F.col("l_quantity").cast(M)
    li = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_ord"), F.col("l_linenumber").alias("row_idx"), qty.alias("quantity"), price.alias("unit_price"), "l_partkey", "l_suppkey",
        F.round(price * F.col("l_discount").cast("decimal(4,2)"), 2).cast(M).alias("discount_amount"), F.when(F.col("l_tax") > 0, F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast(M)).alias("row_tax"))
    total = F.col("quantity") * F.col("unit_price") - F.col("discount_amount") + F.coalesce("row_tax", F.lit(0).cast(M)) + F.when(F.col("row_idx") == 3, F.lit(1)).otherwise(F.lit(0))
    return li.withColumn("row_total", F.when(F.col("l_partkey") % 50 != 0, total.cast(M)))


LINES = """lines AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_idx, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, l_partkey, l_suppkey,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS disc, CASE WHEN l_tax > 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) END AS tax FROM lineitem),
stated AS (SELECT *, q * p - disc + coalesce(tax, 0) AS good, CASE WHEN l_partkey % 50 <> 0 THEN q * p - disc + coalesce(tax, 0) + CASE WHEN row_idx = 3 THEN 1 ELSE 0 END END AS total FROM lines)"""


@query(f"""WITH {LINES}
SELECT doc_id, row_idx AS row_index, 'commercial.row_total_arithmetic' AS rule_name, CASE WHEN total IS NULL THEN 'incomplete' ELSE 'failed' END AS status, CAST(CASE WHEN total IS NOT NULL THEN abs(good - total) END AS DECIMAL(18,2)) AS delta
FROM stated WHERE total IS NULL OR abs(good - total) > 0.01""")
def row_arithmetic(spark, sf_dir):
    out = rules.row_arithmetic(commercial_rows(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "row_index", "rule_name", "status", F.col("delta").cast("decimal(18,2)").alias("delta"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sums of each order: true ones, 2 more for every fifth order, absent for every eleventh."""
    rows = commercial_rows(spark, sf_dir)
    sums = rows.groupBy("doc_id").agg(F.sum("row_total").alias("s"), F.sum("row_tax").alias("t"))
    off = F.when(F.col("doc_id") % 5 == 0, F.lit(2)).otherwise(F.lit(0))
    return sums.select("doc_id", F.when(F.col("doc_id") % 11 != 0, (F.coalesce("s", F.lit(0).cast(M)) + off).cast(M)).alias("SUBTOTAL"), (F.coalesce("t", F.lit(0).cast(M))).cast(M).alias("TAX_AMOUNT"))


@query(f"""WITH {LINES},
g AS (SELECT doc_id, sum(total) AS s, count(*) FILTER (total IS NULL) AS gs, sum(tax) AS t, count(*) FILTER (tax IS NULL) AS gt FROM stated GROUP BY doc_id),
f AS (SELECT *, CASE WHEN doc_id % 11 <> 0 THEN coalesce(s, 0) + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END END AS sub, coalesce(t, 0) AS taxes FROM g)
SELECT doc_id, 'commercial.subtotal_equals_sum_row_totals' AS rule_name, CASE WHEN gs > 0 THEN 'incomplete' WHEN abs(sub - s) <= 0.01 THEN 'passed' ELSE 'failed' END AS status FROM f WHERE sub IS NOT NULL
UNION ALL SELECT doc_id, 'commercial.tax_equals_sum_row_tax', CASE WHEN gt > 0 THEN 'incomplete' WHEN abs(taxes - t) <= 0.01 THEN 'passed' ELSE 'failed' END FROM f""")
def subtotal_tax_checks(spark, sf_dir):
    return rules.sums_against_facts(commercial_rows(spark, sf_dir), order_facts(spark, sf_dir), rules.COMMERCIAL_SUMS).select("doc_id", "rule_name", "status")


def long_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each order in long form, some twice (the first counts)."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast(M)
    tax = F.round(price * F.lit("0.1").cast("decimal(4,2)"), 2).cast(M)
    m = lambda role, v, n: F.struct(F.lit(role).alias("role"), F.lit(n).alias("ord"), v.cast(M).alias("amount"), F.lit(None).cast("date").alias("d"))
    day = lambda role, v, n: F.struct(F.lit(role).alias("role"), F.lit(n).alias("ord"), F.lit(None).cast(M).alias("amount"), v.cast("date").alias("d"))
    off = F.when(F.col("o_orderkey") % 10 == 0, F.lit(1)).otherwise(F.lit(0))
    date = F.to_date("o_orderdate")
    each = F.array(
        m("SUBTOTAL", price, 0), m("TAX_AMOUNT", tax, 1), m("TOTAL_AMOUNT", price + tax + off, 2), m("AMOUNT_PAID", F.lit(100), 3), m("AMOUNT_DUE", price + tax + off - 100, 4), m("SUBTOTAL", F.lit(1), 5),
        m("TAX_RATE", F.when(F.col("o_orderkey") % 4 == 0, F.lit(9)).otherwise(F.lit(10)), 6), day("ISSUE_DATE", date, 7), day("DUE_DATE", F.date_add(date, (F.col("o_custkey") % 40 - 5).cast("int")), 8))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(each).alias("f")).select("doc_id", "f.*")


FACTS = """f AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(18,2)) AS sub, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.1, 2) AS DECIMAL(18,2)) AS tax, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS off,
  CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE 10 END AS rate, CAST(o_orderdate AS DATE) AS issued, CAST(CAST(o_orderdate AS DATE) + to_days(CAST(o_custkey % 40 - 5 AS INTEGER)) AS DATE) AS due FROM orders)"""


@query(f"WITH {FACTS} SELECT doc_id, sub AS SUBTOTAL, tax AS TAX_AMOUNT, sub + tax + off AS TOTAL_AMOUNT, rate AS TAX_RATE, issued AS ISSUE_DATE, due AS DUE_DATE FROM f")
def facts_pivot(spark, sf_dir):
    d = lambda c: F.col(c).cast("decimal(18,2)").alias(c)
    return _wide(spark, sf_dir).select("doc_id", d("SUBTOTAL"), d("TAX_AMOUNT"), d("TOTAL_AMOUNT"), F.col("TAX_RATE").cast("int").alias("TAX_RATE"), "ISSUE_DATE", "DUE_DATE")


def _wide(spark, sf_dir):
    money = ["SUBTOTAL", "TAX_AMOUNT", "TOTAL_AMOUNT", "AMOUNT_PAID", "AMOUNT_DUE", "TAX_RATE"]
    wide = rules.wide_facts(long_facts(spark, sf_dir), {**dict.fromkeys(money, "amount"), "ISSUE_DATE": "d", "DUE_DATE": "d"})
    return wide.withColumn("DISCOUNT_AMOUNT", F.lit(None).cast(M)).withColumn("SHIPPING_FEE", F.lit(None).cast(M))


@query(f"""WITH {FACTS}
SELECT doc_id, 'invoice.total_arithmetic' AS rule_name, CASE WHEN off = 0 THEN 'passed' ELSE 'failed' END AS status FROM f
UNION ALL SELECT doc_id, 'invoice.payment_arithmetic', 'passed' FROM f
UNION ALL SELECT doc_id, 'commercial.tax_rate_multiplier', CASE WHEN abs(round(sub * CAST(rate AS DECIMAL(4,0)) * 0.01, 2) - tax) <= 0.01 THEN 'passed' ELSE 'failed' END FROM f WHERE sub > 0
UNION ALL SELECT doc_id, 'invoice.issue_le_due', CASE WHEN issued <= due THEN 'passed' ELSE 'failed' END FROM f""")
def required_role_rules(spark, sf_dir):
    return emit(_wide(spark, sf_dir), ["doc_id"], rules.invoice_rules()).select("doc_id", "rule_name", "status")


@query("""WITH p AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + to_days(CAST(o_custkey % 50 - 2 AS INTEGER)) AS DATE) AS b FROM orders)
SELECT doc_id, 'payroll.period_length_reasonable' AS rule_name, CASE WHEN b - a BETWEEN 25 AND 35 THEN 'passed' ELSE 'failed' END AS status FROM p
UNION ALL SELECT doc_id, 'certificate.validity_window_ordered', CASE WHEN a <= b THEN 'passed' ELSE 'failed' END FROM p
UNION ALL SELECT doc_id, 'certificate.validity_length_reasonable', CASE WHEN b - a BETWEEN 1 AND 18250 THEN 'passed' ELSE 'failed' END FROM p
UNION ALL SELECT doc_id, 'legal_official.deadline_after_issue', CASE WHEN a <= b THEN 'passed' ELSE 'failed' END FROM p
UNION ALL SELECT doc_id, 'within', CASE WHEN a BETWEEN a AND b THEN 'passed' ELSE 'failed' END FROM p""")
def period_rules(spark, sf_dir):
    a = F.to_date("o_orderdate")
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), a.alias("PERIOD_START"), F.date_add(a, (F.col("o_custkey") % 50 - 2).cast("int")).alias("PERIOD_END"))
    p = p.select("*", *(F.col("PERIOD_START").alias(c) for c in ("VALID_FROM", "ISSUE_DATE")), *(F.col("PERIOD_END").alias(c) for c in ("VALID_UNTIL", "DEADLINE")))
    return emit(p, ["doc_id"], [*rules.period_rules(), rules.within_period("within", "ISSUE_DATE", "VALID_FROM", "VALID_UNTIL")]).select("doc_id", "rule_name", "status")


TYPED = ["INVOICE", "BANK_STATEMENT", "CERTIFICATE", "PAYSLIP", "LEGAL_DOC", "RESUME", "OFFICIAL_DOC", "E_RECEIPT"]


@query(f"""WITH o AS (SELECT o_orderkey AS doc_id, {TYPED}[o_custkey % 8 + 1] AS t, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 60 - 5 AS INTEGER) AS DATE) AS b, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderkey % 3 = 0 AS wrong FROM orders)
SELECT doc_id, 'invoice.issue_le_due' AS rule_name, CASE WHEN a <= b THEN 'passed' ELSE 'failed' END AS status FROM o WHERE t IN ('INVOICE', 'E_RECEIPT')
UNION ALL SELECT doc_id, 'invoice.total_arithmetic', CASE WHEN wrong THEN 'failed' ELSE 'passed' END FROM o WHERE t IN ('INVOICE', 'E_RECEIPT')
UNION ALL SELECT doc_id, 'payroll.period_length_reasonable', CASE WHEN b - a BETWEEN 25 AND 35 THEN 'passed' ELSE 'failed' END FROM o WHERE t = 'PAYSLIP'
UNION ALL SELECT doc_id, 'certificate.validity_window_ordered', CASE WHEN a <= b THEN 'passed' ELSE 'failed' END FROM o WHERE t = 'CERTIFICATE'
UNION ALL SELECT doc_id, 'certificate.validity_length_reasonable', CASE WHEN b - a BETWEEN 1 AND 18250 THEN 'passed' ELSE 'failed' END FROM o WHERE t = 'CERTIFICATE'
UNION ALL SELECT doc_id, 'legal_official.deadline_after_issue', CASE WHEN a <= b THEN 'passed' ELSE 'failed' END FROM o WHERE t IN ('LEGAL_DOC', 'OFFICIAL_DOC')
UNION ALL SELECT doc_id, 'legal_official.validity_window', CASE WHEN a <= b THEN 'passed' ELSE 'failed' END FROM o WHERE t IN ('LEGAL_DOC', 'OFFICIAL_DOC')""")
def rules_by_document_type(spark, sf_dir):
    """All registered rules on declared facts: those for certain types of document are given for these types only."""
    a = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*map(F.lit, TYPED)), (F.col("o_custkey") % 8 + 1).cast("int")).alias("document_type"), a.alias("a"),
        F.date_add(a, (F.col("o_custkey") % 60 - 5).cast("int")).alias("b"), F.col("o_totalprice").cast("decimal(18,2)").cast(M).alias("total"), (F.col("o_orderkey") % 3 == 0).alias("wrong"))
    starts, ends = ("ISSUE_DATE", "PERIOD_START", "VALID_FROM"), ("DUE_DATE", "PERIOD_END", "VALID_UNTIL", "DEADLINE")
    none = F.lit(None).cast(M)
    wide = o.select("doc_id", *(F.col("a").alias(c) for c in starts), *(F.col("b").alias(c) for c in ends), F.col("total").alias("SUBTOTAL"), (F.col("total") + F.when(F.col("wrong"), F.lit(7)).otherwise(F.lit(0))).cast(M).alias("TOTAL_AMOUNT"),
        *(none.alias(c) for c in ("DISCOUNT_AMOUNT", "TAX_AMOUNT", "TAX_RATE", "SHIPPING_FEE", "AMOUNT_PAID", "AMOUNT_DUE")))
    found = rules.run_rules({"wide": wide, "documents": o.select("doc_id", F.lower("document_type").alias("document_type"))})
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "rule_name", "status")


@query("""SELECT o_orderkey AS doc_id, 'universal.dates_not_in_future' AS rule_name FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-01' + INTERVAL 30 DAY
UNION ALL SELECT o_orderkey, 'universal.percentage_range' FROM orders WHERE NOT o_orderkey % 130 - 10 BETWEEN -0.01 AND 100.01""")
def future_dates_percentages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    role = lambda r, **v: F.struct(F.lit(r).alias("role"), v.get("pct", F.lit(None)).cast(M).alias("pct"), F.lit(None).cast(M).alias("amount"), v.get("d", F.lit(None)).cast("date").alias("d"))
    f = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(role("DUE_DATE", d=F.to_date("o_orderdate")), role("TAX_RATE", pct=F.col("o_orderkey") % 130 - 10))).alias("f")).select("doc_id", "f.*")
    return rules.fact_results(f, "1997-06-01").select("doc_id", "rule_name")


@query("""SELECT c_custkey AS doc_id, string_agg(DISTINCT c, ',' ORDER BY c) AS actual FROM (
  SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['MYR', 'USD'] WHEN c_custkey % 3 = 1 THEN ['MYR', 'MYR'] ELSE ['CNY', 'JPY', 'XXX'] END) AS c FROM customer) GROUP BY c_custkey HAVING count(DISTINCT c) > 1""")
def currency_consistency(spark, sf_dir):
    names = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("RM"), F.lit(" us$ "))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("rm"), F.lit("Ringgit Malaysia"))).otherwise(F.array(F.lit("RMB"), F.lit("¥"), F.lit("xxx")))
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(names).alias("currency"))
    return rules.currency_results(f).select("doc_id", "actual")


# ---- versions and rates

RATES = [("A", "1992-01-01", "0.11"), ("A", "1995-01-01", "0.12"), ("A", "1997-06-01", "0.13"), ("B", "1994-01-01", "0.05")]
RATES_SQL = "rates AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', DATE '{d}', CAST({r} AS DECIMAL(18,6)))" for k, d, r in RATES) + ") t(k, since, rate))"


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "k string, since string, rate string").select("k", F.col("since").cast("date").alias("since"), F.col("rate").cast(M).alias("rate"))


@query(f"""WITH {RATES_SQL}, o AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS k, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
l AS (SELECT k, arg_max(rate, since) AS last FROM rates GROUP BY k)
SELECT o_orderkey, k, d, CASE WHEN d IS NULL THEN last ELSE rate END AS rate FROM (SELECT o.o_orderkey, o.k, o.d, r.rate FROM o ASOF LEFT JOIN rates r ON o.k = r.k AND o.d >= r.since) JOIN l USING (k)""")
def asof_rate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("k"), F.when(F.col("o_orderkey") % 17 != 0, F.to_date("o_orderdate")).alias("d"))
    return joins.as_of(o, rates(spark), ["k"], "d", "since", ["rate"])


@query(f"""WITH {RATES_SQL}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS DECIMAL(18,6)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN abs(v / 100 - 0.11) <= abs(v - 0.11) THEN v / 100 ELSE v END AS DECIMAL(18,6)) AS rate FROM r""")
def rate_disambiguation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.nearer_rate(F.col("l_quantity").cast(M), F.lit("0.11").cast(M)).alias("rate"))


@query(f"""WITH {RATES_SQL}, o AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
m AS (SELECT o_orderkey, amount, rate, CASE WHEN o_orderkey % 3 = 0 THEN CAST(11 AS DECIMAL(18,6)) ELSE CAST(0.12 AS DECIMAL(18,6)) END AS stated FROM (SELECT o.*, r.rate FROM o ASOF JOIN rates r ON o.k = r.k AND o.d >= r.since)),
n AS (SELECT *, CASE WHEN abs(stated / 100 - rate) <= abs(stated - rate) THEN stated / 100 ELSE stated END AS s FROM m)
SELECT o_orderkey AS doc_id, CASE WHEN abs(s - rate) <= 0.005 THEN 'passed' ELSE 'failed' END AS status FROM n""")
def statutory_rate_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("row_idx"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("key"), F.lit("employee").alias("role"), F.to_date("o_orderdate").alias("event_date"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("11")).otherwise(F.lit("0.12")).cast(M).alias("stated_rate"), F.lit(None).cast(M).alias("amount"), F.lit(None).cast(M).alias("base"))
    v = rates(spark).select(F.col("k").alias("key"), F.lit("employee").alias("role"), F.col("since").alias("effective_from"), "rate", F.lit("0.005").cast(M).alias("tolerance"))
    return rules.statutory_rates(rows, v).select("doc_id", "status")


@query("""WITH r AS (SELECT o_custkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'BASIC_SALARY' WHEN 1 THEN 'BONUS' WHEN 2 THEN 'EPF_EMPLOYEE' WHEN 3 THEN 'TAX_DEDUCTION' WHEN 4 THEN 'EPF_EMPLOYER' ELSE 'ALLOWANCE' END AS c,
  CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS a FROM orders),
k AS (SELECT doc_id, CASE WHEN c IN ('BASIC_SALARY', 'BONUS', 'ALLOWANCE') THEN 'payroll.gross_pay_check' WHEN c = 'EPF_EMPLOYER' THEN 'payroll.employer_contribution_check' ELSE 'payroll.employee_deduction_check' END AS rule_name, a FROM r),
g AS (SELECT doc_id, rule_name, sum(a) AS s, count(*) FILTER (a IS NULL) AS gaps FROM k GROUP BY ALL),
t AS (SELECT doc_id, coalesce(sum(s) FILTER (rule_name = 'payroll.gross_pay_check'), 0) AS gross, coalesce(sum(s) FILTER (rule_name = 'payroll.employee_deduction_check'), 0) AS ded FROM g GROUP BY doc_id)
SELECT doc_id, rule_name, CASE WHEN gaps > 0 THEN 'incomplete' WHEN rule_name = 'payroll.gross_pay_check' AND doc_id % 9 = 0 THEN 'failed' ELSE 'passed' END AS status FROM g
UNION ALL SELECT doc_id, 'payroll.net_pay_check', CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'passed' END FROM t""")
def payroll_checks(spark, sf_dir):
    names = ["BASIC_SALARY", "BONUS", "EPF_EMPLOYEE", "TAX_DEDUCTION", "EPF_EMPLOYER", "ALLOWANCE"]
    comp = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_ord"), comp.alias("component"), F.when(F.col("o_orderkey") % 31 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast(M)).alias("amount"))
    total = lambda of: F.coalesce(F.sum(F.when(F.col("component").isin(of), F.col("amount"))), F.lit(0).cast(M)).cast(M)
    wide = rows.groupBy("doc_id").agg(total(rules.EARNINGS).alias("g"), total(rules.DEDUCTIONS).alias("EMPLOYEE_DEDUCTION_TOTAL"), total(rules.CONTRIBUTIONS).alias("EMPLOYER_CONTRIBUTION_TOTAL"))
    wide = wide.select("doc_id", "EMPLOYEE_DEDUCTION_TOTAL", "EMPLOYER_CONTRIBUTION_TOTAL", (F.col("g") + F.when(F.col("doc_id") % 9 == 0, F.lit(4)).otherwise(F.lit(0))).cast(M).alias("GROSS_PAY"), (F.col("g") - F.col("EMPLOYEE_DEDUCTION_TOTAL")).cast(M).alias("NET_PAY"))
    return rules.payroll_sums(rows, wide).select("doc_id", "rule_name", "status")


@query("""SELECT c_custkey AS doc_id, 'official.amounts_non_negative' AS rule_name FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'resume.employment_dates_ordered' FROM customer WHERE c_custkey % 21 > 15""")
def official_and_resume(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    amounts = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("table_ord"), F.lit(0).alias("row_idx"), F.lit("FEE").alias("component"), F.col("c_acctbal").cast("decimal(18,2)").cast(M).alias("amount"))
    jobs = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("table_ord"), F.lit(0).alias("row_idx"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 21).cast("int")).alias("start_date"), F.lit("2000-01-16").cast("date").alias("end_date"))
    return rules.non_negative(amounts).select("doc_id", "rule_name").unionByName(rules.ordered_dates(jobs, "resume.employment_dates_ordered").select("doc_id", "rule_name"))


# ---- identifiers


@query("""WITH d AS (SELECT c_custkey, printf('%016d', c_custkey * 7919) AS n FROM customer),
s AS (SELECT c_custkey, n, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(n[i] AS INTEGER) * 2 > 9 THEN CAST(n[i] AS INTEGER) * 2 - 9 ELSE CAST(n[i] AS INTEGER) * 2 END ELSE CAST(n[i] AS INTEGER) END)) AS t FROM d)
SELECT c_custkey AS doc_id, n AS actual FROM s WHERE t % 10 <> 0""")
def luhn_scan(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("ACCOUNT_NUMBER").alias("key"), F.format_string("%016d", F.col("c_custkey") * 7919).alias("value"))
    return rules.key_results(keys).select("doc_id", "actual")


@query("""WITH d AS (SELECT c_custkey, printf('%02d%02d%02d', c_custkey % 100, c_custkey % 14, c_custkey % 33) || '-' || printf('%02d', c_custkey % 90) || '-' || printf('%04d', c_custkey % 10000) AS v FROM customer),
p AS (SELECT *, CAST(substr(v, 1, 2) AS INTEGER) AS yy, CAST(substr(v, 8, 2) AS INTEGER) AS place FROM d)
SELECT c_custkey, v, CASE WHEN TRY_CAST((CASE WHEN yy <= 30 THEN '20' ELSE '19' END) || substr(v, 1, 2) || '-' || substr(v, 3, 2) || '-' || substr(v, 5, 2) AS DATE) IS NULL THEN 'date' WHEN NOT (place BETWEEN 1 AND 16 OR place BETWEEN 21 AND 59 OR place = 82) THEN 'place' END AS fault FROM p""")
def mykad_format(spark, sf_dir):
    k = F.col("c_custkey")
    v = F.concat(F.format_string("%02d%02d%02d", k % 100, k % 14, k % 33), F.lit("-"), F.format_string("%02d", k % 90), F.lit("-"), F.format_string("%04d", k % 10000))
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"), strings.mykad_fault(v).alias("fault"))


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_days(9000) AS DATE) AS d FROM orders),
r AS (SELECT o_orderkey, d, CASE o_orderkey % 5 WHEN 0 THEN 'INV-' || strftime(d, '%Y%m%d') || '-7' WHEN 1 THEN 'REF ' || strftime(d, '%Y/%m/%d') WHEN 2 THEN 'Q' || strftime(d, '%d.%m.%Y') || 'x' WHEN 3 THEN 'no ' || strftime(d, '%d %b %Y') ELSE 'INV-99999999-' || o_orderkey END AS ref FROM o)
SELECT o_orderkey, ref, CASE WHEN o_orderkey % 5 < 4 AND year(d) BETWEEN 2015 AND 2040 THEN d END AS found FROM r""")
def reference_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 9000).alias("d"))
    k = F.col("o_orderkey") % 5
    form = lambda f: F.date_format("d", f)
    ref = F.when(k == 0, F.concat(F.lit("INV-"), form("yyyyMMdd"), F.lit("-7"))).when(k == 1, F.concat(F.lit("REF "), form("yyyy/MM/dd"))).when(k == 2, F.concat(F.lit("Q"), form("dd.MM.yyyy"), F.lit("x"))).when(k == 3, F.concat(F.lit("no "), form("dd MMM yyyy"))).otherwise(F.concat(F.lit("INV-99999999-"), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", ref.alias("ref"), dates.reference_date(ref).alias("found"))
