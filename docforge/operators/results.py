"""Rule results: one struct for each result, built in place so that many rules share a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MONEY_TOLERANCE, dec

PASSED, FAILED, SKIPPED, INCOMPLETE = "passed", "failed", "skipped", "incomplete"


def text(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(c).cast("string")


def result(rule: str, status, expected=None, actual=None, delta=None, row_index=None, reason=None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_name"), text(status).alias("status"), text(expected).alias("expected"), text(actual).alias("actual"),
        text(delta).alias("delta"), (row_index if isinstance(row_index, Column) else F.lit(row_index)).cast("int").alias("row_index"), text(reason).alias("reason"),
    )


def compared(rule: str, expected: Column, actual: Column, tolerance: str = MONEY_TOLERANCE, silent: bool = False, incomplete: bool = True, row_index=None) -> Column:
    """The four-state check of two amounts: incomplete (or nothing) if one is missing, passed (or nothing if silent) or failed."""
    known = expected.isNotNull() & actual.isNotNull()
    delta = F.abs(expected - actual)
    ok = delta <= dec(tolerance)
    out = F.when(known & ~ok, result(rule, FAILED, expected, actual, delta, row_index))
    if not silent:
        out = out.when(known & ok, result(rule, PASSED, expected, actual, delta, row_index))
    if incomplete:
        out = out.when(~known, result(rule, INCOMPLETE, expected, actual, None, row_index, "missing value"))
    return out


def emit(rows: DataFrame, keys: list[str], results: list[Column]) -> DataFrame:
    """A row for each result that isn't null, from one pass over rows."""
    return rows.select(*keys, F.explode(F.array_compact(F.array(*results))).alias("r")).select(*keys, "r.*")


def status_counts(results: DataFrame, by: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return results.groupBy(*by).agg(*map(n, (PASSED, FAILED, SKIPPED, INCOMPLETE)))


def confidence(rule: Column, expected: Column, actual: Column, delta: Column) -> Column:
    """How far a failure is to be trusted. The ladder; statistics .55, dates .9, balances .75, then by the relative deviation."""
    d = delta.try_cast("decimal(38,6)")
    base = F.greatest(F.abs(F.coalesce(expected.try_cast("decimal(38,6)"), dec(0))), F.abs(F.coalesce(actual.try_cast("decimal(38,6)"), dec(0))), F.lit(1).cast("decimal(38,6)"))
    return (
        F.when(F.contains(rule, F.lit("benford")), 0.55)
        .when(F.contains(rule, F.lit("date")), 0.9)
        .when(F.contains(rule, F.lit("running_balance")) | F.contains(rule, F.lit("balance_change")), 0.75)
        .when(d.isNull(), 0.9)
        .when(d < dec(MONEY_TOLERANCE), 0.5)
        .when(d * 100 >= base, 0.9)
        .when(d * 1000 >= base, 0.75)
        .otherwise(0.55)
    )


#: Types of the evidence that a failed rule is.
EVIDENCE_TYPES = {
    "universal.dates_not_in_future": "RECONCILIATION_DATE_OUT_OF_RANGE",
    "universal.currency_consistency": "RECONCILIATION_CURRENCY_MISMATCH",
    "universal.percentage_range": "RECONCILIATION_AMOUNT_OUT_OF_RANGE",
    "universal.account_number_luhn_check": "RECONCILIATION_LUHN_CHECKSUM_FAILED",
    "universal.person_id_mykad_check": "RECONCILIATION_MYKAD_FORMAT_INVALID",
    "bank.opening_matches_first_row": "RECONCILIATION_BALANCE_MISMATCH",
    "bank.running_balance_recursion": "RECONCILIATION_RUNNING_BALANCE_MISMATCH",
    "bank.closing_matches_last_row": "RECONCILIATION_BALANCE_MISMATCH",
    "bank.sum_flow_matches_balance_change": "RECONCILIATION_BALANCE_MISMATCH",
    "bank.flow_signed_consistency": "RECONCILIATION_ROW_FIELD_CONFLICT",
    "bank.row_flow_exclusive": "RECONCILIATION_ROW_FIELD_CONFLICT",
    "bank.period_contains_all_txns": "RECONCILIATION_DATE_OUT_OF_PERIOD",
    "bank.chronology_monotonic": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "commercial.row_total_arithmetic": "RECONCILIATION_ROW_MATH_MISMATCH",
    "commercial.subtotal_equals_sum_row_totals": "RECONCILIATION_SUBTOTAL_MISMATCH",
    "commercial.tax_equals_sum_row_tax": "RECONCILIATION_TAX_MISMATCH",
    "commercial.tax_rate_multiplier": "RECONCILIATION_TAX_MISMATCH",
    "commercial.id_date_vs_issue_date": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "payroll.gross_pay_check": "RECONCILIATION_NET_PAY_MISMATCH",
    "payroll.employee_deduction_check": "RECONCILIATION_NET_PAY_MISMATCH",
    "payroll.employer_contribution_check": "RECONCILIATION_NET_PAY_MISMATCH",
    "payroll.net_pay_check": "RECONCILIATION_NET_PAY_MISMATCH",
    "payroll.statutory_rate_check": "RECONCILIATION_STATUTORY_RATE_MISMATCH",
    "payroll.period_length_reasonable": "RECONCILIATION_DATE_OUT_OF_RANGE",
    "payroll.chronology_monotonic": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "official.amounts_non_negative": "RECONCILIATION_AMOUNT_OUT_OF_RANGE",
    "statistical.benford_first_digit": "RECONCILIATION_BENFORD_ANOMALY",
    "invoice.total_arithmetic": "RECONCILIATION_TOTAL_MISMATCH",
    "invoice.payment_arithmetic": "RECONCILIATION_TOTAL_MISMATCH",
    "invoice.issue_le_due": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "certificate.validity_window_ordered": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "certificate.validity_length_reasonable": "RECONCILIATION_DATE_OUT_OF_RANGE",
    "certificate.issue_le_expiry": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "legal_official.deadline_after_issue": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "legal_official.validity_window": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "resume.employment_dates_ordered": "RECONCILIATION_DATE_ORDER_VIOLATION",
    "resume.education_dates_ordered": "RECONCILIATION_DATE_ORDER_VIOLATION",
}


def to_evidence(results: DataFrame, keys: list[str]) -> DataFrame:
    """Failures as evidence with their confidence."""
    failed = results.filter(F.col("status") == FAILED)
    named = F.create_map(*(F.lit(x) for pair in EVIDENCE_TYPES.items() for x in pair))[F.col("rule_name")]
    kind = F.coalesce(named, F.upper(F.concat(F.lit("RECONCILIATION_"), F.regexp_replace("rule_name", "[.]", "_"))))
    return failed.select(*keys, kind.alias("type"), "rule_name", F.to_json(F.struct("expected", "actual", "delta")).alias("value"), F.lit("reconciliation").alias("source"), "row_index", confidence(F.col("rule_name"), F.col("expected"), F.col("actual"), F.col("delta")).alias("confidence"))


def split_results(results: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a case file: failures apart (they are evidence), the incomplete ones kept, the others counted by rule."""
    rest = results.filter(F.col("status").isin(PASSED, SKIPPED)).groupBy(*by, "rule_name", "status").agg(F.count("*").alias("n"))
    return results.filter(F.col("status") == FAILED), results.filter(F.col("status") == INCOMPLETE), rest
