"""JSON texts of models: the object in them, its checks and its defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RISKS = ["low", "medium", "high", "critical"]
REPORT = "struct<summary:string,overall_risk:string,risks:array<struct<risk:string,evidence_ids:array<string>,confidence:string>>>"


def json_object(text: Column) -> Column:
    """The text in a fence if there is one, else the whole if it begins as an object, else from its first to its last brace."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    whole = F.trim(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(whole.rlike(r"(?s)^\{.*\}$"), whole).when(inner != "", inner)


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value: the parser alone would let trailing text pass, so the braces at both ends are asked for."""
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.trim(text).rlike(r"(?s)^\{.*\}$"), F.lit(False))


def report(text: Column) -> Column:
    """summary, overall_risk (one of the known levels, else medium) and risks with a text; null for what isn't JSON."""
    r = F.from_json(F.when(is_json(json_object(text)), json_object(text)), REPORT)
    level = F.lower(F.trim(r["overall_risk"]))
    risks = F.filter(F.coalesce(r["risks"], F.array().cast("array<struct<risk:string,evidence_ids:array<string>,confidence:string>>")), lambda x: F.coalesce(F.trim(x["risk"]) != "", F.lit(False)))
    return F.when(r.isNotNull(), F.struct(r["summary"].alias("summary"), F.when(level.isin(RISKS), level).otherwise("medium").alias("overall_risk"), risks.alias("risks")))


def mapped_confidence(base: Column, n_ids: Column, has_value: Column, has_location: Column) -> Column:
    """0.7, and .05 for cited lines, .1 for a value, .1 for a place, .9 at most; a stated number within 0 to 1 is taken as it is."""
    earned = F.lit(0.7) + F.when(n_ids > 0, 0.05).otherwise(0.0) + F.when(has_value, 0.1).otherwise(0.0) + F.when(has_location, 0.1).otherwise(0.0)
    return F.coalesce(F.when(base.between(0, 1), base), F.least(earned, F.lit(0.9)))


def nearest_enum(text: Column, allowed: list[str], least: float = 0.8) -> Column:
    """The allowed word itself, or the one most like it by edit distance if it is `least` alike (of equal ones the first)."""
    t = F.upper(F.regexp_replace(F.trim(text), r"[\s\-]+", "_"))
    scored = F.array(*(F.struct((1 - F.levenshtein(t, F.lit(a)) / F.greatest(F.length(t), F.lit(len(a)))).alias("s"), F.lit(-i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(allowed)))
    best = F.array_max(scored)
    return F.when(t.isin(allowed), t).when(best["s"] >= least, best["a"])
