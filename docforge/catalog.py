"""The library's queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from .plans.base import ORACLES, QUERIES

MODULES = ("documents", "ledgers", "statistics", "matching", "pages", "cases", "visuals", "extraction")

#: Result columns that are given as plain types on both sides, so that exact and binary numbers, wide integers and dates compare alike.
CASTS = {
    "row_arithmetic": {"delta": "DOUBLE"},
    "facts_pivot": {"SUBTOTAL": "DOUBLE", "TAX_AMOUNT": "DOUBLE", "TOTAL_AMOUNT": "DOUBLE", "ISSUE_DATE": "VARCHAR", "DUE_DATE": "VARCHAR"},
    "asof_rate": {"d": "VARCHAR", "rate": "DOUBLE"},
    "rate_disambiguation": {"rate": "DOUBLE"},
    "reference_dates": {"found": "VARCHAR"},
    "ledger_running_balance": {"expected": "DOUBLE", "balance": "DOUBLE", "delta": "DOUBLE"},
    "ledger_islands": {"delta": "DOUBLE"},
    "chronology_monotonic": {"before": "VARCHAR", "d": "VARCHAR"},
    "period_contains": {"event_date": "VARCHAR"},
    "evidence_confidence": {"confidence": "DOUBLE"},
    "rare_bars_log_mad": {"n": "BIGINT"},
    "style_distribution": {"weight": "BIGINT"},
    "dominant_key": {"weight": "BIGINT"},
    "scope_merge": {"confidence": "DOUBLE"},
    "producer_risk": {"risk_score": "DOUBLE"},
    "expand_ids": {"total": "BIGINT"},
    "numeric_tokens": {"total": "DOUBLE"},
    "parse_dates": {"d": "VARCHAR"},
    "y_sessionise": {"session": "BIGINT"},
    "depth_profile": {"most": "BIGINT"},
    "evidence_dedupe_index": {"confidence": "DOUBLE"},
    "case_file": {"most": "DOUBLE"},
    "file_rules_one_scan": {"confidence": "DOUBLE"},
    "timeline": {"at_time": "VARCHAR"},
    "file_rules_further": {"confidence": "DOUBLE"},
    "occluded_objects": {"confidence": "DOUBLE"},
}
_SPARK = {"DOUBLE": "double", "VARCHAR": "string", "BIGINT": "bigint"}


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"docforge.plans.{m}")


def _cast(f, casts: dict[str, str]):
    return lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast(_SPARK[t]) for c, t in casts.items()})


def queries() -> dict:
    _load()
    return {n: _cast(f, CASTS[n]) if n in CASTS else f for n, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    replaced = lambda casts: ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in casts.items())
    return {n: f"SELECT * REPLACE ({replaced(CASTS[n])}) FROM ({sql})" if n in CASTS else sql for n, sql in ORACLES.items()}
