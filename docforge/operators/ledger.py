"""Checks of account statements: running balances, flows, chronology. Each window is one table of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import MONEY_TOLERANCE, dec
from .results import FAILED, INCOMPLETE, PASSED, compared, emit, result

TABLE = ["doc_id", "table_ord"]


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), dec(0))


def running_balance(rows: DataFrame) -> DataFrame:
    """rows (doc_id, table_ord, row_idx, flow_in, flow_out, balance) with expected, delta and state of each row but the first.

    The stated balance before, not the computed one, is carried on, so that one wrong row shows once or twice.
    """
    w = Window.partitionBy(*TABLE).orderBy("row_idx")
    before, first = F.lag("balance").over(w), F.row_number().over(w) == 1
    expected = before + _zero("flow_in") - _zero("flow_out")
    out = rows.withColumn("expected", expected).withColumn("is_first", first).filter(~F.col("is_first")).drop("is_first")
    delta = F.abs(F.col("expected") - F.col("balance"))
    return out.withColumn("delta", delta).withColumn("state", F.when(F.col("delta").isNull(), INCOMPLETE).when(F.col("delta") > dec(MONEY_TOLERANCE), FAILED).otherwise(PASSED))


def islands(rows: DataFrame, hit: Column, by: list[str], order: str) -> DataFrame:
    """Runs of consecutive rows for which hit holds, numbered by island: order minus rank is constant in a run of whole numbers."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.filter(hit).withColumn("island", F.col(order) - F.row_number().over(w))


def balance_results(rows: DataFrame) -> DataFrame:
    """Running-balance results: an island of failed rows is one failure with the sum of its deltas, the incomplete rows are one result."""
    checked = running_balance(rows)
    runs = islands(checked, F.col("state") == FAILED, TABLE, "row_idx").groupBy(*TABLE, "island")
    failed = runs.agg(F.min("row_idx").alias("row_index"), F.max("row_idx").alias("last_row"), F.count("*").alias("n_rows"), F.sum("delta").alias("delta"))
    gaps = checked.filter(F.col("state") == INCOMPLETE).groupBy(*TABLE).agg(F.min("row_idx").alias("row_index"), F.max("row_idx").alias("last_row"), F.count("*").alias("n_rows"))
    name = F.lit("bank.running_balance_recursion").alias("rule_name")
    amount = "decimal(28,6)"
    return failed.select(*TABLE, name, F.lit(FAILED).alias("status"), "row_index", "last_row", "n_rows", F.col("delta").cast(amount).alias("delta")).unionByName(
        gaps.select(*TABLE, name, F.lit(INCOMPLETE).alias("status"), "row_index", "last_row", "n_rows", F.lit(None).cast(amount).alias("delta"))
    )


def table_results(rows: DataFrame, facts: DataFrame, facts_columns: tuple[str, str] = ("OPENING_BALANCE", "CLOSING_BALANCE")) -> DataFrame:
    """Opening and closing balance against the first and last row, and the sum of flows against their difference.

    facts: one row a document. The opening may be stated before or after the first row's flows.
    """
    by_row = lambda c: F.struct("row_idx", F.col(c).alias("v"), "flow_in", "flow_out")
    ends = rows.groupBy(*TABLE).agg(F.min(by_row("balance")).alias("first"), F.max(by_row("balance")).alias("last"), F.sum(_zero("flow_in")).cast("decimal(28,6)").alias("total_in"), F.sum(_zero("flow_out")).cast("decimal(28,6)").alias("total_out"))
    opening, closing = (F.col(c) for c in facts_columns)
    j = ends.join(facts, "doc_id")
    first = F.col("first.v")
    carried = (opening + F.coalesce(F.col("first.flow_in"), dec(0)) - F.coalesce(F.col("first.flow_out"), dec(0))).cast("decimal(18,6)")
    expected = F.when(F.abs(opening - first) <= dec(MONEY_TOLERANCE), opening).otherwise(carried)
    change, net = (closing - opening).cast("decimal(28,6)"), (F.col("total_in") - F.col("total_out")).cast("decimal(28,6)")
    known = change.isNotNull()
    gap = F.abs(net - change)
    total = F.when(known & (gap <= dec(MONEY_TOLERANCE)), result("bank.sum_flow_matches_balance_change", PASSED, net, change, gap)).when(known, result("bank.sum_flow_matches_balance_change", FAILED, net, change, gap))
    has = lambda c, r: F.when(c.isNotNull(), r)
    return emit(j, TABLE, [has(opening, compared("bank.opening_matches_first_row", expected, first)), has(closing, compared("bank.closing_matches_last_row", closing, F.col("last.v"))), total])


def flow_results(rows: DataFrame) -> DataFrame:
    """Signed flows whose sign contradicts in and out, and rows that have both an inflow and an outflow."""
    expected = _zero("flow_in") - _zero("flow_out")
    sign = F.when(F.col("flow_signed").isNotNull() & (expected != 0) & (F.signum(F.col("flow_signed")) != F.signum(expected)), result("bank.flow_signed_consistency", FAILED, expected, F.col("flow_signed"), None, F.col("row_idx")))
    both = F.when((F.abs(F.col("flow_in")) > 0) & (F.abs(F.col("flow_out")) > 0), result("bank.row_flow_exclusive", FAILED, F.col("flow_in"), F.col("flow_out"), None, F.col("row_idx")))
    return emit(rows, TABLE, [sign, both])


def chronology(rows: DataFrame, by: list[str] = TABLE, date: str = "event_date", order: str = "row_idx", keep: int = 3) -> DataFrame:
    """Adjacent dated rows against the direction from the first to the last: the first `keep` violations of each table."""
    dated = rows.filter(F.col(date).isNotNull())
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    ends = dated.withColumn("before", F.lag(date).over(w)).withColumn("up", F.max_by(date, order).over(whole) >= F.min_by(date, order).over(whole))
    wrong = ends.filter(F.col("before").isNotNull() & F.when(F.col("up"), F.col(date) < F.col("before")).otherwise(F.col(date) > F.col("before")))
    return wrong.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select(*by, order, "before", date, "up", "n")


def outside_period(rows: DataFrame, facts: DataFrame, slack: int = 3, date: str = "event_date") -> DataFrame:
    """Rows dated outside the document's period, `slack` days allowed."""
    j = rows.join(facts.select("doc_id", "PERIOD_START", "PERIOD_END"), "doc_id")
    return j.filter(~F.col(date).between(F.date_sub("PERIOD_START", slack), F.date_add("PERIOD_END", slack)))
