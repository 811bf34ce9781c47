"""Routing of named entities to lookups, fallbacks, and outcomes: no target is lost on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small

#: Type of entity and its route.
ROUTES = {
    "BANK": "bnm",
    "WEBSITE": "whois",
    "ORGANIZATION": "whitelist",
    "VENDOR": "whitelist",
    "ACCOUNT": "enterprise",
    "TRANSACTION": "enterprise",
    "INVOICE": "enterprise",
    "QUOTATION": "enterprise",
    "RECEIPT": "enterprise",
    "PURCHASE_ORDER": "enterprise",
    "CONTRACT": "enterprise",
    "CASE": "enterprise",
    "CERTIFICATE": "enterprise",
    "PERSON": "unverifiable",
    "CUSTOMER": "unverifiable",
    "EMPLOYEE": "unverifiable",
    "PRODUCT": "unverifiable",
    "ADDRESS": "unverifiable",
    "GOVERNMENT_AGENCY": "unverifiable",
    "UNIVERSITY": "unverifiable",
    "PROFESSIONAL_BODY": "unverifiable",
    "LAW_FIRM": "unverifiable",
    "OTHER": "web_search",
}
#: Scores of risk levels; a type without a level is "unknown", a producer that isn't known scores nothing.
RISK_SCORES = {"low": 0.2, "medium": 0.5, "high": 0.75, "critical": 0.95, "unknown": 0.3}
DEFAULT_ROUTE = "web_search"
DECISIVE = ["EXACT_MATCH", "FUZZY_MATCH", "ALERT"]


def route(entity_type: Column, override: Column | None = None) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))[entity_type]
    return F.coalesce(*([override] if override is not None else []), known, F.lit(DEFAULT_ROUTE))


def fallback(targets: DataFrame, answers: DataFrame, web: DataFrame | None = None, key: str = "target_id") -> DataFrame:
    """outcome and stream of every target: its decisive answer; else the web's, if there is one; else UNVERIFIABLE."""
    decisive = answers.filter(F.col("outcome").isin(DECISIVE)).groupBy(key).agg(F.min("outcome").alias("_o"))
    out = targets.join(decisive, key, "left")
    found = web.groupBy(key).agg(F.min("outcome").alias("_w")) if web is not None else targets.select(key).limit(0).withColumn("_w", F.lit(None).cast("string"))
    out = out.join(found, key, "left")
    outcome = F.coalesce("_o", "_w", F.lit("UNVERIFIABLE"))
    stream = F.when(F.col("_o").isNotNull(), F.when(F.col("route") == "enterprise", "enterprise").otherwise("deterministic")).when(F.col("_w").isNotNull(), "web").otherwise("deterministic")
    return out.withColumn("outcome", outcome).withColumn("stream", stream).drop("_o", "_w")


def enterprise(targets: DataFrame, connectors: list[DataFrame], key: str = "key") -> DataFrame:
    """The first connector (in their order) that knows the key; NOT_FOUND if one answered for it, else UNVERIFIABLE.

    connectors: tables of key, found (false: looked for and absent), record."""
    every = None
    for i, c in enumerate(connectors):
        part = c.select(key, "found", "record", F.lit(i).alias("o"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(key).agg(F.min(F.when(F.col("found"), F.struct("o", "record"))).alias("b"))
    out = targets.join(best.withColumn("_a", F.lit(True)), key, "left")
    return out.withColumn("outcome", F.when(F.col("b").isNotNull(), "EXACT_MATCH").when(F.col("_a"), "NOT_FOUND").otherwise("UNVERIFIABLE")).withColumn("record", F.col("b.record")).drop("b", "_a")


def web_outcome(error: Column, sources: Column, summary_error: Column, outcome: Column, snippet_chars: int = 200) -> Column:
    short = F.exists(sources, lambda s: F.length(s["snippet"]) > snippet_chars)
    return F.when(error.isNotNull(), "UNVERIFIABLE").when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "NOT_FOUND").when(summary_error.isNotNull(), F.when(short, "PARTIAL").otherwise("UNVERIFIABLE")).otherwise(F.coalesce(outcome, F.lit("UNVERIFIABLE")))


def web_confidence(sources: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(sources, lambda s: s["score"])), F.lit(0.5))


def align_summaries(asked: DataFrame, answers: DataFrame, by: str = "batch") -> DataFrame:
    """asked (batch, i from 0) with the summary of its index: answers may count from 0 or 1, the first of an index holds, others are errors."""
    base = answers.groupBy(by).agg(F.min("index").alias("least"), F.max("index").alias("most"))
    n = asked.groupBy(by).agg(F.count("*").alias("n"))
    shift = base.join(n, by).select(by, F.when((F.col("least") >= 1) & (F.col("most") <= F.col("n")), 1).otherwise(0).alias("shift"))
    placed = answers.join(shift, by).withColumn("i", F.col("index") - F.col("shift")).groupBy(by, "i").agg(F.min(F.struct("position", "summary"))["summary"].alias("summary"))
    return asked.join(placed, [by, "i"], "left").withColumn("error", F.when(F.col("summary").isNull(), "missing summary"))


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "stream").agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in ("EXACT_MATCH", "FUZZY_MATCH", "ALERT", "NOT_FOUND", "UNVERIFIABLE")))


def risk(rows: DataFrame, table: DataFrame, producer: str = "producer", kind: str = "document_type") -> DataFrame:
    """level and risk_score of a producer for a type of document: unknown where the table says nothing, with 0 if it doesn't know the producer at all."""
    t = table.groupBy(F.lower("producer").alias("_p")).agg(F.map_from_entries(F.collect_set(F.struct(F.lower("document_type").alias("k"), "level"))).alias("_levels"))
    out = rows.join(small(t), F.lower(producer) == F.col("_p"), "left")
    out = out.withColumn("level", F.coalesce(F.try_element_at("_levels", F.lower(kind)), F.lit("unknown")))
    scores = F.create_map(*(F.lit(x) for pair in RISK_SCORES.items() for x in pair))
    return out.withColumn("risk_score", F.when(F.col("_p").isNull(), 0.0).otherwise(F.coalesce(scores[F.col("level")], F.lit(RISK_SCORES["unknown"])))).drop("_p", "_levels")


#: Fields that are matched as they are; of others only words are.
RAW_FIELDS = ("header_binary", "pdf_version", "structure")


def score_fingerprints(values: DataFrame, patterns: DataFrame, key: str = "doc_id") -> DataFrame:
    """values (key, field, value) against patterns (producer, field, pattern, weight): score of each producer with a hit.

    A pattern counts towards its producer's weight whether or not its field is there. Patterns are a dimension.
    """
    total = patterns.groupBy("producer").agg(F.sum("weight").alias("total"))
    plain = F.trim(F.regexp_replace("value", r"(?U)[^\w]+", " "))
    values = values.withColumn("value", F.when(F.col("field").isin(*RAW_FIELDS), F.col("value")).otherwise(plain))
    met = values.join(small(patterns), "field").filter(F.expr("rlike(value, pattern)"))
    hits = met.select(key, "producer", "field", "pattern", "weight").distinct().groupBy(key, "producer").agg(F.sum("weight").alias("hit"))
    return hits.join(small(total), "producer").select(key, "producer", (F.col("hit") / F.col("total")).alias("score"))
