"""Extracted values against the lines they cite, and the conflicts of a page's structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fuzzy, strings, values
from . import joins

#: Classes of table columns.
DATE_COLUMNS = ["EVENT_DATE", "POSTING_DATE", "ISSUE_DATE", "EXPIRY_DATE", "VALID_FROM", "VALID_UNTIL", "START_DATE", "END_DATE", "DEADLINE", "PERIOD_START", "PERIOD_END"]
TEXT_COLUMNS = ["DESC", "PRODUCT", "REFERENCE"]


def cited(rows: DataFrame, lines: DataFrame, ids: str = "obs", key: str = "row_id") -> DataFrame:
    """rows with seen and seen_lines: the texts of the lines that their identifiers name, in order, joined and as a list; empty without any.

    Rows are dealt to all cores, as they are few bytes that cost much to compare.
    """
    first = lines.groupBy("doc_id", "observation_id").agg(F.min("text").alias("text"))
    each = rows.select("doc_id", key, F.posexplode(ids).alias("_p", "observation_id"))
    seen = each.join(first, ["doc_id", "observation_id"]).groupBy("doc_id", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "text"))), lambda x: x["text"]).alias("seen_lines"))
    out = joins.spread(rows, "doc_id", key).join(seen, ["doc_id", key], "left").withColumn("seen_lines", F.coalesce("seen_lines", F.array().cast("array<string>")))
    return out.withColumn("seen", F.array_join("seen_lines", " "))


def facts_against_lines(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, ord, role, kind of each fact without a source, or whose amount or date the cited lines don't have."""
    f = cited(facts.withColumn("row_id", F.col("ord")), lines)
    has_amount = F.exists(values.numeric_tokens(F.col("seen")), lambda x: F.abs(x) == F.abs(F.col("amount")))
    kind = (
        F.when(F.coalesce(F.size("obs"), F.lit(0)) <= 0, "missing_source")
        .when(F.col("seen") == "", "invalid_observation_id")
        .when(F.col("amount").isNotNull() & ~has_amount, "vlm_ocr_numeric_mismatch")
        .when(F.col("d").isNotNull() & ~dates.mentioned(F.col("d"), F.col("seen")), "vlm_ocr_date_mismatch")
    )
    return f.withColumn("kind", kind).filter("kind is not null").select("doc_id", "ord", "role", "kind")


def cells_against_lines(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """cells (doc_id, table_ord, row_idx, column, value, obs, table_obs) to their conflicts, by the column's class.

    A text without lines of its own is looked for in the table's; dates must be ISO dates; a table whose cells cite nothing at all is one conflict.
    """
    key = F.struct("table_ord", "row_idx", "column")
    c = cited(cells.withColumn("row_id", F.to_json(key)), lines)
    c = cited(c.withColumnsRenamed({"seen": "own", "seen_lines": "own_lines"}), lines, "table_obs")
    texts = F.when(F.size("own_lines") > 0, F.col("own_lines")).otherwise(F.col("seen_lines"))
    is_date, is_text = F.col("column").isin(DATE_COLUMNS), F.col("column").isin(TEXT_COLUMNS)
    number = values.normal_number(F.col("value"))
    kind = (
        F.when(is_date & ~dates.is_iso_date(F.col("value")), "vlm_date_format_violation")
        .when((F.col("own") == "") & ~is_text, F.lit(None).cast("string"))
        .when(is_date & ~dates.mentioned(dates.iso_date(F.col("value")), F.col("own")), "vlm_ocr_date_mismatch")
        .when(is_text & F.col("checked") & (F.size(texts) > 0) & ~fuzzy.is_text_covered(F.when(F.col("checked"), F.col("value")), texts), "vlm_ocr_text_mismatch")
        .when(~is_date & ~is_text & values.is_numeric_cell(F.col("value")) & number.isNotNull() & ~F.exists(values.numeric_tokens(F.col("own")), lambda x: F.abs(x) == F.abs(number)), "vlm_ocr_numeric_mismatch")
    )
    c = c.withColumn("checked", F.col("value").isNotNull() & is_text & strings.should_check_text(F.col("value")))
    found = c.withColumn("kind", kind).filter("value is not null and kind is not null").select("doc_id", "table_ord", "row_idx", "column", "kind")
    none = cells.groupBy("doc_id", "table_ord").agg(F.sum(F.coalesce(F.size("obs"), F.lit(0))).alias("n")).filter("n <= 0").select("doc_id", "table_ord", F.lit("missing_source").alias("kind"))
    return found.unionByName(none, allowMissingColumns=True)


def targets_against_lines(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """targets (doc_id, ord, value, keys, obs): the value and each key, numbers as numbers, else as text."""
    each = targets.select("doc_id", "ord", "obs", F.posexplode(F.concat(F.array("value"), F.transform("keys", lambda k: k["value"]))).alias("pos", "v"))
    c = cited(each.withColumn("row_id", F.concat_ws(".", "ord", "pos")), lines).filter("v is not null and seen <> ''")
    number = values.normal_number(F.col("v"))
    numeric = F.coalesce(values.is_numeric_cell(F.col("v")), F.lit(False))
    c = c.withColumn("checked", ~numeric & strings.should_check_text(F.col("v")))
    absent = number.isNotNull() & ~F.exists(values.numeric_tokens(F.col("seen")), lambda x: F.abs(x) == F.abs(number)) & ~F.contains("seen", F.col("v"))
    kind = F.when(numeric, F.when(absent, "vlm_ocr_numeric_mismatch")).when(F.col("checked") & ~fuzzy.is_text_covered(F.when(F.col("checked"), F.col("v")), F.col("seen_lines")), "vlm_ocr_text_mismatch")
    return c.withColumn("kind", kind).filter("kind is not null").select("doc_id", "ord", "pos", "kind")


def structure_conflicts(lines: DataFrame, regions: DataFrame, assigned: DataFrame, tables: DataFrame, layout_tables: DataFrame, least: float = 0.7) -> DataFrame:
    """Conflicts of a page's structure: lines in no region, text regions without lines or text, regions whose text
    differs from their lines' (whole texts are compared), and tables of the layout that the grid detector missed (where it ran at all).

    assigned: doc_id, observation_id, region_id. Tables: doc_id, page.
    """
    lost = lines.join(assigned.filter("region_id is not null"), ["doc_id", "observation_id"], "left_anti").select("doc_id", F.col("observation_id").cast("string").alias("item"), F.lit("unassigned_observation").alias("kind"))
    texts = assigned.join(lines, ["doc_id", "observation_id"]).groupBy("doc_id", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("observation_id", "text"))), lambda x: x["text"]), " ").alias("seen"))
    r = joins.spread(regions.filter("is_text"), "doc_id", "region_id").join(texts, ["doc_id", "region_id"], "left")
    claims = F.coalesce(F.trim("text"), F.lit("")) != ""
    kind = F.when(claims & F.col("seen").isNull(), "region_without_lines").when(~claims & F.col("seen").isNull(), "empty_region").when(claims & ~fuzzy.is_alike(F.col("text"), F.col("seen"), least), "text_differs")
    bad = r.withColumn("kind", kind).filter("kind is not null").select("doc_id", F.col("region_id").cast("string").alias("item"), "kind")
    ran = tables.select("doc_id").distinct()
    missed = layout_tables.join(ran, "doc_id", "left_semi").join(tables.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").select("doc_id", F.col("page").cast("string").alias("item"), F.lit("grid_missed_table").alias("kind"))
    return lost.unionByName(bad).unionByName(missed)
