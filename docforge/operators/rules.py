"""Rules over declared facts and typed tables. Facts become one wide row a document, so that all rules on them share a scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, strings, values
from ..functions.values import MONEY_TOLERANCE, dec
from .results import FAILED, INCOMPLETE, PASSED, compared, emit, result

#: Roles of dates and rates, components of payslips.
DATE_ROLES = ["ISSUE_DATE", "DUE_DATE", "PERIOD_START", "PERIOD_END", "VALID_FROM", "VALID_UNTIL", "DEADLINE", "TRANSACTION_DATETIME", "PAYMENT_DATETIME"]
RATE_ROLES = ["TAX_RATE", "DISCOUNT_RATE", "INTEREST_RATE", "PENALTY_RATE"]
EARNINGS = ["BASIC_SALARY", "OVERTIME_PAY", "ALLOWANCE", "BONUS", "COMMISSION", "OTHER_EARNING"]
DEDUCTIONS = ["EPF_EMPLOYEE", "SOCSO_EMPLOYEE", "EIS_EMPLOYEE", "TAX_DEDUCTION", "EMPLOYEE_DEDUCTION", "OTHER_DEDUCTION"]
CONTRIBUTIONS = ["EPF_EMPLOYER", "SOCSO_EMPLOYER", "EIS_EMPLOYER", "EMPLOYER_CONTRIBUTION", "OTHER_CONTRIBUTION"]
NON_NEGATIVE = ["TAX", "DUTY", "FEE", "PENALTY", "GRANT", "BENEFIT", "REFUND", "ASSESSMENT", "LIABILITY"]


def wide_facts(facts: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row a document with the first fact (by ord) of each role; roles: role -> column of facts that holds its value."""
    first = lambda role, c: F.min(F.when(F.col("role") == role, F.struct("ord", F.col(c).alias("v"))))["v"].alias(role)
    return facts.groupBy("doc_id").agg(*(first(r, c) for r, c in roles.items()))


def normal_facts(facts: DataFrame) -> DataFrame:
    """facts with normal (money, else date, else null) and verified."""
    money = F.coalesce("amount", "pct", "qty")
    normal = F.coalesce(money.cast("string"), F.col("d").cast("string"))
    return facts.withColumn("normal", normal).withColumn("verified", normal.isNotNull())


# ---- one fact at a time


def fact_results(facts: DataFrame, today: str | None = None, slack_days: int = 30) -> DataFrame:
    """Dates beyond `slack_days` after the day of evaluation, and percentages outside 0 to 100 (a hundredth allowed).

    The day is that of the document's first ISSUE_DATE (by ord, where facts have one); without one it is `today`, or the current day.
    """
    first = F.struct(F.col("ord") if "ord" in facts.columns else F.lit(0).alias("ord"), F.col("d"))
    issued = F.min(F.when((F.col("role") == "ISSUE_DATE") & F.col("d").isNotNull(), first)).over(Window.partitionBy("doc_id"))
    day = F.coalesce(issued.getField("d"), F.lit(today).cast("date") if today else F.current_date())
    rows = facts.withColumn("_day", day)
    late = F.when(F.col("role").isin(DATE_ROLES) & (F.col("d") > F.date_add("_day", slack_days)), result("universal.dates_not_in_future", FAILED, F.col("_day"), F.col("d")))
    pct = F.when(F.col("role").isin(RATE_ROLES) & ~F.coalesce("pct", "amount").between(dec("-0.01"), dec("100.01")), result("universal.percentage_range", FAILED, "0..100", F.coalesce("pct", "amount")))
    return emit(rows, ["doc_id"], [late, pct])


def currency_results(facts: DataFrame) -> DataFrame:
    """Documents whose facts name more than one currency."""
    sets = facts.filter("currency is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(strings.currency(F.col("currency")))).alias("c"))
    return sets.filter(F.size("c") > 1).select("doc_id", F.lit("universal.currency_consistency").alias("rule_name"), F.lit(FAILED).alias("status"), F.array_join("c", ",").alias("actual"))


def key_results(keys: DataFrame) -> DataFrame:
    """keys (doc_id, key, value): account numbers that fail Luhn's sum where it applies, and malformed identity numbers."""
    digits = F.regexp_replace("value", "[ -]", "")
    rows = keys.withColumn("digits", digits)
    luhn = F.when((F.col("key") == "ACCOUNT_NUMBER") & values.luhn_applies(F.col("digits")) & ~values.luhn_ok("digits"), result("universal.account_number_luhn_check", FAILED, None, F.col("value")))
    fault = strings.mykad_fault(F.col("value"))
    person = F.when((F.col("key") == "PERSON_ID") & strings.mykad_digits(F.col("value")).rlike("^[0-9]{12}$") & fault.isNotNull(), result("universal.person_id_mykad_check", FAILED, None, F.col("value"), None, None, fault))
    return emit(rows, ["doc_id"], [luhn, person])


# ---- facts of one document


def start_le_end(rule: str, start: str, end: str) -> Column:
    a, b = F.col(start), F.col(end)
    return F.when(a <= b, result(rule, PASSED, a, b)).when(a > b, result(rule, FAILED, a, b))


def within_period(rule: str, date: str, start: str, end: str) -> Column:
    d, inside = F.col(date), F.col(date).between(F.col(start), F.col(end))
    return F.when(inside, result(rule, PASSED, None, d)).when(~inside, result(rule, FAILED, None, d))


def length_between(rule: str, start: str, end: str, least: int, most: int) -> Column:
    n = F.datediff(end, start)
    return F.when(n.between(least, most), result(rule, PASSED, f"{least}..{most}", n)).when(n.isNotNull(), result(rule, FAILED, f"{least}..{most}", n))


def _sum(*terms: tuple[int, str]) -> Column:
    """Terms beyond the first count as 0 if absent."""
    out = F.col(terms[0][1])
    for sign, c in terms[1:]:
        out = out + F.coalesce(F.col(c), dec(0)) * sign
    return out.cast("decimal(18,6)")


def _there(*columns: str) -> Column:
    return F.expr(" AND ".join(f"{c} IS NOT NULL" for c in columns))


def tax_rate() -> Column:
    """Tax by its rate on the subtotal less the discount; a base of nothing is passed over."""
    base = _sum((1, "SUBTOTAL"), (-1, "DISCOUNT_AMOUNT"))
    by_rate = F.round(base * values.rate_multiplier(F.col("TAX_RATE"), F.lit("PERCENT")), 2).cast("decimal(18,6)")
    return F.when(_there("SUBTOTAL", "TAX_RATE", "TAX_AMOUNT") & (base > 0), compared("commercial.tax_rate_multiplier", by_rate, F.col("TAX_AMOUNT"), incomplete=False))


def invoice_totals() -> list[Column]:
    total = compared("invoice.total_arithmetic", _sum((1, "SUBTOTAL"), (-1, "DISCOUNT_AMOUNT"), (1, "TAX_AMOUNT"), (1, "SHIPPING_FEE")), F.col("TOTAL_AMOUNT"), incomplete=False)
    paid = compared("invoice.payment_arithmetic", _sum((1, "TOTAL_AMOUNT"), (-1, "AMOUNT_PAID")), F.col("AMOUNT_DUE"), incomplete=False)
    return [F.when(_there("SUBTOTAL", "TOTAL_AMOUNT"), total), F.when(_there("TOTAL_AMOUNT", "AMOUNT_PAID", "AMOUNT_DUE"), paid)]


def invoice_rules() -> list[Column]:
    return [*invoice_totals(), tax_rate(), start_le_end("invoice.issue_le_due", "ISSUE_DATE", "DUE_DATE")]


def net_pay() -> Column:
    return compared("payroll.net_pay_check", (F.col("GROSS_PAY") - F.col("EMPLOYEE_DEDUCTION_TOTAL")).cast("decimal(18,6)"), F.col("NET_PAY"), incomplete=False)


def period_rules() -> list[Column]:
    return [
        length_between("payroll.period_length_reasonable", "PERIOD_START", "PERIOD_END", 25, 35),
        start_le_end("certificate.validity_window_ordered", "VALID_FROM", "VALID_UNTIL"),
        length_between("certificate.validity_length_reasonable", "VALID_FROM", "VALID_UNTIL", 1, 18250),
        start_le_end("legal_official.deadline_after_issue", "ISSUE_DATE", "DEADLINE"),
    ]


def issue_le_expiry() -> Column:
    return start_le_end("certificate.issue_le_expiry", "ISSUE_DATE", "EXPIRY_DATE")


def reference_date_rule(reference: str = "reference", issue: str = "ISSUE_DATE", slack: int = 0) -> Column:
    """The date in a document's number is not the issue date."""
    d = dates.reference_date(F.col(reference))
    return F.when(F.abs(F.datediff(d, F.col(issue))) > slack, result("commercial.id_date_vs_issue_date", FAILED, F.col(issue), d))


# ---- tables


def row_arithmetic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """quantity * unit_price - discount + tax against row_total: discount and tax may be missing, the others make it incomplete."""
    product = (F.col("quantity") * F.col("unit_price")).cast("decimal(28,6)")
    expected = (product - F.coalesce("discount_amount", dec(0)) + F.coalesce("row_tax", dec(0))).cast("decimal(18,6)")
    return emit(rows, keys, [compared("commercial.row_total_arithmetic", expected, F.col("row_total"), silent=True, row_index=F.col("row_idx"))])


def sums_against_facts(rows: DataFrame, facts: DataFrame, checks: list[tuple[str, str, str]], by: tuple[str, ...] = ("doc_id", "table_ord")) -> DataFrame:
    """checks: (rule, column, role). Each table's sum of the column against the document's fact; a missing cell makes it incomplete."""
    sums = rows.groupBy(*by).agg(*(x for _, c, _ in checks for x in (F.sum(c).cast("decimal(28,6)").alias(f"sum_{c}"), F.count_if(F.col(c).isNull()).alias(f"gap_{c}"))))
    j = sums.join(facts, "doc_id")
    each = [F.when(F.col(role).isNotNull(), compared(rule, F.col(role).cast("decimal(28,6)"), F.when(F.col(f"gap_{c}") == 0, F.col(f"sum_{c}")))) for rule, c, role in checks]
    return emit(j, list(by), each)


COMMERCIAL_SUMS = [("commercial.subtotal_equals_sum_row_totals", "row_total", "SUBTOTAL"), ("commercial.tax_equals_sum_row_tax", "row_tax", "TAX_AMOUNT")]
PAYROLL_SUMS = [("payroll.gross_pay_check", EARNINGS, "GROSS_PAY"), ("payroll.employee_deduction_check", DEDUCTIONS, "EMPLOYEE_DEDUCTION_TOTAL"), ("payroll.employer_contribution_check", CONTRIBUTIONS, "EMPLOYER_CONTRIBUTION_TOTAL")]


def payroll_sums(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Sums of the components of each class against gross pay, deductions and contributions; net pay from the facts."""
    amount = lambda of: F.when(F.col("component").isin(of), F.col("amount"))
    part = {role: of for _, of, role in PAYROLL_SUMS}
    sums = rows.groupBy("doc_id", "table_ord").agg(*(x for role, of in part.items() for x in (F.sum(amount(of)).cast("decimal(28,6)").alias(f"sum_{role}"), F.count_if(F.col("component").isin(of) & F.col("amount").isNull()).alias(f"gap_{role}"), F.count_if(F.col("component").isin(of)).alias(f"n_{role}"))))
    j = sums.join(facts, "doc_id")
    each = [F.when(F.col(role).isNotNull() & (F.col(f"n_{role}") > 0), compared(rule, F.col(role).cast("decimal(28,6)"), F.when(F.col(f"gap_{role}") == 0, F.col(f"sum_{role}")))) for rule, _, role in PAYROLL_SUMS]
    return emit(j, ["doc_id", "table_ord"], [*each, net_pay()])


def statutory_rates(rows: DataFrame, rates: DataFrame, date: str = "event_date") -> DataFrame:
    """Each component's rate (stated, or amount / base) against the version of the rates that is in force, within its tolerance.

    rates: key, role, rate, tolerance, effective_from: a small dimension, measured by its own loader.
    """
    from .joins import as_of

    met = as_of(rows, rates, ["key", "role"], date, "effective_from", ["rate", "tolerance"])
    stated = F.when(F.col("stated_rate").isNotNull(), values.nearer_rate(F.col("stated_rate"), F.col("rate"))).otherwise(F.try_divide("amount", "base").cast("decimal(18,6)"))
    delta = F.abs(stated - F.col("rate"))
    r = F.when(delta <= F.col("tolerance"), result("payroll.statutory_rate_check", PASSED, F.col("rate"), stated, delta)).when(delta.isNotNull(), result("payroll.statutory_rate_check", FAILED, F.col("rate"), stated, delta))
    return emit(met, ["doc_id", "row_idx"], [r])


def non_negative(rows: DataFrame) -> DataFrame:
    return emit(rows, ["doc_id", "table_ord"], [F.when(F.col("component").isin(NON_NEGATIVE) & (F.col("amount") < 0), result("official.amounts_non_negative", FAILED, ">= 0", F.col("amount"), None, F.col("row_idx")))])


def ordered_dates(rows: DataFrame, rule: str) -> DataFrame:
    return emit(rows, ["doc_id", "table_ord"], [F.when(F.col("start_date") > F.col("end_date"), result(rule, FAILED, F.col("start_date"), F.col("end_date"), None, F.col("row_idx")))])


# ---- registry


@dataclass(frozen=True)
class Rule:
    """name: of the registry; needs: tables that build takes; document_types: of the documents that it is for, empty for all."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    document_types: tuple[str, ...] = ()


REGISTRY: dict[str, Rule] = {}
RESULT_COLUMNS = ("doc_id", "rule_name", "status", "expected", "actual", "delta", "row_index", "reason")


def register(rule: Rule) -> None:
    REGISTRY[rule.name] = rule


#: Documents whose results a task sorts at a time, where they meet their types.
DOCUMENTS = 250_000


def run_rules(tables: dict[str, DataFrame], enabled: set[str] | None = None, columns: tuple[str, ...] = RESULT_COLUMNS) -> DataFrame:
    """The results of all registered rules whose tables are given.

    With a table `documents` (doc_id, document_type) rules for certain types give results for documents of these types only; the types are
    met once, by one join of all results. A rule whose plan can't be built gives a skipped row for each document, or
    one row without a document where that table isn't given.
    """
    documents = tables.get("documents")
    parts, types = [], {(): 0}
    for rule in REGISTRY.values():
        if (enabled is not None and rule.name not in enabled) or not all(n in tables for n in rule.needs):
            continue
        try:
            out = rule.build(*(tables[n] for n in rule.needs))
        except AnalysisException as e:  # a rule that can't be planned must not stop the others
            of = documents.select("doc_id") if documents is not None else next(iter(tables.values())).sparkSession.range(1).select(F.lit(None).cast("string").alias("doc_id"))
            out = of.select("doc_id", F.lit(rule.name).alias("rule_name"), F.lit("skipped").alias("status"), F.lit(str(e)[:200]).alias("reason"))
        kind = lambda c: "int" if c == "row_index" else "string"
        part = out.select(*(F.col(c).cast(kind(c)) if c in out.columns else F.lit(None).cast(kind(c)).alias(c) for c in columns))
        types.setdefault(rule.document_types, len(types))
        parts.append(part.withColumn("_types", F.lit(types[rule.document_types])))
    out = reduce(DataFrame.unionByName, parts)
    if documents is not None:
        of_type = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.upper("document_type").alias("_type"))
        # so many tasks that none has the results of more than some DOCUMENTS
        spark = documents.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // DOCUMENTS))
        dealt = out.filter(F.col("_types") > 0).repartition(tasks, "doc_id")
        fits = reduce(Column.__or__, (F.col("_types").eqNullSafe(n) & F.col("_type").isin(*of) for of, n in types.items() if of), F.lit(False))
        typed = dealt.join(of_type.repartition(tasks, "doc_id"), "doc_id").filter(fits).drop("_type")
        out = out.filter(F.col("_types") == 0).unionByName(typed)
    return out.drop("_types")


def _ledger(name: str):
    from . import ledger

    return getattr(ledger, name)


def _failed(rows: DataFrame, rule: str, expected: Column, actual: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule_name"), F.lit(FAILED).alias("status"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"), F.col("row_idx").alias("row_index"))


def _chronology(rule: str):
    return lambda rows: _failed(_ledger("chronology")(rows), rule, F.col("before"), F.col("event_date"))


def _period(rows: DataFrame, wide: DataFrame) -> DataFrame:
    return _failed(_ledger("outside_period")(rows, wide), "bank.period_contains_all_txns", F.concat_ws("..", "PERIOD_START", "PERIOD_END"), F.col("event_date"))


#: Columns of each type of table whose first digits are tested.
BENFORD_COLUMNS = {"BANK_TRANSACTIONS": ["FLOW_OUT", "FLOW_IN"], "COMMERCIAL_LINES": ["ROW_TOTAL", "UNIT_PRICE"], "PAYROLL": ["AMOUNT"]}


def benford_amounts(cells: DataFrame) -> DataFrame:
    """amounts (doc_id, table_ord, column, amount) of table rows (doc_id, table_ord, table_type, cells map): the columns that the type of table has for first digits."""
    of = F.create_map(*(x for t, cs in BENFORD_COLUMNS.items() for x in (F.lit(t), F.array(*map(F.lit, cs)))))
    each = cells.select("doc_id", "table_ord", "cells", F.explode(F.try_element_at(of, F.upper("table_type"))).alias("column"))
    return each.select("doc_id", "table_ord", "column", values.to_decimal(F.try_element_at("cells", F.col("column"))).alias("amount")).filter("amount is not null")


def _benford(amounts: DataFrame) -> DataFrame:
    from .stats import benford

    zones = benford(amounts.withColumn("digit", values.first_digit(F.col("amount").cast("string"))), ["doc_id", "table_ord", "column"], "digit")
    status = F.when(F.col("zone") == "failed", FAILED).otherwise(PASSED)
    return zones.select("doc_id", F.lit("statistical.benford_first_digit").alias("rule_name"), status.alias("status"), F.col("zone").alias("actual"), F.col("mad").alias("delta"))


def on_facts(*rules: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda wide: emit(wide, ["doc_id"], [r() for r in rules])


INVOICES = ("INVOICE", "QUOTATION", "RECEIPT", "E_RECEIPT")
# for all documents: by their facts, keys and typed tables
register(Rule("universal.facts", ("facts",), fact_results))
register(Rule("universal.currency", ("facts",), currency_results))
register(Rule("universal.keys", ("keys",), key_results))
register(Rule("bank.running_balance", ("bank_rows",), lambda r: _ledger("balance_results")(r)))
register(Rule("bank.tables", ("bank_rows", "wide"), lambda r, w: _ledger("table_results")(r, w)))
register(Rule("bank.flows", ("bank_rows",), lambda r: _ledger("flow_results")(r)))
register(Rule("commercial.rows", ("commercial_rows",), lambda r: row_arithmetic(r, ["doc_id", "table_ord"])))
register(Rule("commercial.sums", ("commercial_rows", "wide"), lambda r, w: sums_against_facts(r, w, COMMERCIAL_SUMS)))
register(Rule("commercial.tax_rate", ("wide",), on_facts(tax_rate)))
register(Rule("payroll.sums", ("payroll_rows", "wide"), payroll_sums))
register(Rule("payroll.statutory", ("statutory_rows", "rates"), statutory_rates))
register(Rule("official.amounts", ("official_rows",), non_negative))
register(Rule("statistical.benford", ("amounts",), _benford))
# for documents of certain types
register(Rule("bank.period", ("bank_rows", "wide"), _period, ("BANK_STATEMENT",)))
register(Rule("bank.chronology", ("bank_rows",), _chronology("bank.chronology_monotonic"), ("BANK_STATEMENT",)))
register(Rule("invoice.totals", ("wide",), lambda w: emit(w, ["doc_id"], invoice_totals()), INVOICES))
register(Rule("invoice.dates", ("wide",), on_facts(lambda: start_le_end("invoice.issue_le_due", "ISSUE_DATE", "DUE_DATE")), INVOICES))
register(Rule("invoice.reference", ("references",), on_facts(reference_date_rule), INVOICES))
register(Rule("payroll.period", ("wide",), on_facts(lambda: length_between("payroll.period_length_reasonable", "PERIOD_START", "PERIOD_END", 25, 35)), ("PAYSLIP",)))
register(Rule("payroll.chronology", ("dated_rows",), _chronology("payroll.chronology_monotonic"), ("PAYSLIP",)))
register(Rule("certificate.window", ("wide",), on_facts(lambda: start_le_end("certificate.validity_window_ordered", "VALID_FROM", "VALID_UNTIL")), ("CERTIFICATE",)))
register(Rule("certificate.length", ("wide",), on_facts(lambda: length_between("certificate.validity_length_reasonable", "VALID_FROM", "VALID_UNTIL", 1, 18250)), ("CERTIFICATE",)))
register(Rule("certificate.expiry", ("expiries",), on_facts(issue_le_expiry), ("CERTIFICATE",)))
register(Rule("legal_official.deadline", ("wide",), on_facts(lambda: start_le_end("legal_official.deadline_after_issue", "ISSUE_DATE", "DEADLINE")), ("LEGAL_DOC", "OFFICIAL_DOC")))
register(Rule("legal_official.window", ("wide",), on_facts(lambda: start_le_end("legal_official.validity_window", "VALID_FROM", "VALID_UNTIL")), ("LEGAL_DOC", "OFFICIAL_DOC")))
register(Rule("resume.employment", ("employment_rows",), lambda r: ordered_dates(r, "resume.employment_dates_ordered"), ("RESUME",)))
register(Rule("resume.education", ("education_rows",), lambda r: ordered_dates(r, "resume.education_dates_ordered"), ("RESUME",)))
