"""Evidence: fingerprints, merging, numbering, grouping and the case file; votes and merges of partial extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import compress_ids


def engine_of(source: Column) -> Column:
    """Parts of source names, in this order."""
    s = F.lower(F.coalesce(source, F.lit("")))
    has = lambda *parts: F.expr("false") if not parts else F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(s, p))
    return (
        F.when(has("metadata", "exiftool", "analyzer", "collector"), "MetadataEngine")
        .when(has("visual") | F.startswith(s, F.lit("pdf_")) | F.startswith(s, F.lit("image_")), "VisualEngine")
        .when(has("reconciliation", "recon."), "ReconciliationEngine")
        .when(has("semantic"), "SemanticEngine")
        .otherwise("Other")
    )


def fingerprint(*columns: str) -> Column:
    """Of a canonical JSON text: fields in the order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def merge_evidence(rows: DataFrame, by: list[str], fp: str, order: str, confidence: str) -> DataFrame:
    """One row for each fingerprint: the most confident (of equal ones the first), at the place of the first."""
    best = F.max(F.struct(F.col(confidence).alias("c"), (-F.col(order)).alias("o"), F.struct(*[c for c in rows.columns if c not in by]).alias("row")))
    out = rows.groupBy(*by, fp).agg(best["row"].alias("row"), F.min(order).alias("first"))
    keep = [c for c in rows.columns if c not in by and c not in (fp, order)]
    return out.select(*by, fp, F.col("first").alias(order), *(F.col(f"row.{c}").alias(c) for c in keep))


def index_evidence(rows: DataFrame, by: list[str], order: list, group: list[str]) -> DataFrame:
    """evidence_id E001... in order and group_id G001... by the first appearance of a group. format_string never truncates."""
    w = Window.partitionBy(*by)
    n = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_f", F.min("_n").over(Window.partitionBy(*by, *group)))
    g = n.withColumn("_g", F.dense_rank().over(w.orderBy("_f")))
    return g.withColumn("evidence_id", F.format_string("E%03d", "_n")).withColumn("group_id", F.format_string("G%03d", "_g")).drop("_n", "_f", "_g")


def vote(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value; of equal ones the one seen first. contested: there was another."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return c.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("o")).alias("o"))).alias(value), F.max("n").alias("votes"), (F.count("*") > 1).alias("contested"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row (by order) of each key."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return out.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_parts(parts: DataFrame) -> DataFrame:
    """parts (doc_id, part, document_type, page_count, ids): one row a document: voted type, most pages, all identifiers."""
    voted = vote(parts, ["doc_id"], "document_type", "part")
    agg = parts.groupBy("doc_id").agg(F.max("page_count").alias("page_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return agg.join(voted, "doc_id")


def top_conflicts(rows: DataFrame, by: list[str], order: list, most: int = 5) -> DataFrame:
    """The first conflicts of each group, and one row with the number of all where there are more (is_summary)."""
    w = Window.partitionBy(*by)
    n = rows.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    kept = n.filter(F.col("n") <= most).withColumn("is_summary", F.lit(False))
    more = n.filter((F.col("n") == 1) & (F.col("total") > most)).withColumn("is_summary", F.lit(True))
    return kept.unionByName(more)


def case_files(documents: DataFrame, evidence: DataFrame, results: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row a document: evidence in order, incomplete checks, and counts of the others by rule and status."""
    ev = evidence.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("evidence_id", "group_id", "type", "confidence"))).alias("evidence"))
    inc = results.filter("status = 'incomplete'").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rule_name", "row_index"))).alias("incomplete"))
    n = results.filter("status in ('passed', 'skipped')").groupBy(by, "rule_name", "status").agg(F.count("*").alias("n"))
    counts = n.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rule_name", "status", "n"))).alias("counts"))
    return documents.join(ev, by, "left").join(inc, by, "left").join(counts, by, "left")


def render_case(evidence: Column, most: int = 800) -> Column:
    """A case's evidence as lines of text, cut to `most` characters with dots."""
    body = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e["evidence_id"], F.lit(" ["), e["type"], F.lit("] "), F.format_number(e["confidence"], 2))), "\n")
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body)


def cut_text(value: Column, most: int = 800, mark: str = "... (truncated)") -> Column:
    """A value's text, cut to `most` characters with a mark that says so."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit(mark))).otherwise(value)


def compressed(ids: Column) -> Column:
    return F.array_join(compress_ids(ids), ",")


def referenced(observations: DataFrame, evidence: DataFrame, by: str = "doc_id") -> DataFrame:
    used = evidence.select(by, F.explode("observation_ids").alias("observation_id")).distinct()
    return observations.join(used, [by, "observation_id"], "left_semi")
