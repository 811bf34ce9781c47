"""Registrable domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import MOST_BROADCAST


def host(url: Column) -> Column:
    """The host of a URL or bare name, in lower case, without user, port and final dot; null if there is none or it is an address of numbers."""
    h = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#\[\]]+)", 1))
    h = F.regexp_replace(h, r"\.$", "")
    return F.when((h != "") & ~h.rlike(r"^[0-9.]+$|^\.|\.\.") & h.contains("."), h)


def suffix_rules(lines: DataFrame, line: str = "rule") -> DataFrame:
    """rule, kind (plain, wildcard, exception), labels: rules as public lists write them (`com`, `*.ck`, `!www.ck`); comments and blanks are left out."""
    r = F.lower(F.regexp_extract(F.trim(F.col(line)), r"^([^\s/]\S*)", 1))
    kind = F.when(r.startswith("!"), "exception").when(r.startswith("*."), "wildcard").otherwise("plain")
    bare = lines.select(r.alias("rule"), kind.alias("kind")).filter("rule <> ''").distinct()
    bare = bare.withColumn("rule", F.regexp_replace("rule", r"^(!|\*\.)", ""))
    return bare.withColumn("labels", F.size(F.split("rule", r"\.")))


def registrable(rows: DataFrame, url: str, rules: DataFrame, name: str = "domain", most_labels: int = 8) -> DataFrame:
    """rows with suffix and `name`, the suffix and one label more: the domain that can be registered.

    The longest rule that the host ends with holds; `*.x` stands for each label before x, an exception `!y.x` makes x the suffix. Each number of labels that rules have
    is one equality with those rules, which are counted and broadcast, so that rows are neither multiplied nor shuffled. Null: no host, no rule, or nothing before
    the suffix (a public suffix itself).
    """
    n = rules.groupBy("labels").agg(F.count("*").alias("n")).collect()
    if sum(r["n"] for r in n) > MOST_BROADCAST or max((r["labels"] for r in n), default=0) > most_labels:
        raise ValueError(f"at most {MOST_BROADCAST} rules of at most {most_labels} labels")
    out = rows.withColumn("_host", host(F.col(url)))
    size = F.size(F.split("_host", r"\."))
    held = []
    for k in sorted(r["labels"] for r in n):
        flags = rules.filter(F.col("labels") == k).groupBy(F.col("rule").alias(f"_r{k}")).agg(*(F.bool_or(F.col("kind") == x).alias(f"_{x}{k}") for x in ("plain", "wildcard", "exception")))
        out = out.withColumn(f"_s{k}", F.when(size >= k, F.substring_index("_host", ".", -k))).join(F.broadcast(flags), F.col(f"_s{k}") == F.col(f"_r{k}"), "left")
        held.append(k)
    has = lambda x, k: F.coalesce(F.col(f"_{x}{k}"), F.lit(False))
    # labels of the suffix that each rule makes; an exception wins over all others
    made = [F.when(has("exception", k), F.lit(k - 1)) for k in reversed(held)]
    plain = F.greatest(F.lit(0), F.lit(0), *(F.when(has("wildcard", k) & (size > k), k + 1).when(has("plain", k), k).otherwise(0) for k in held))
    labels = F.coalesce(*made, plain) if made else F.lit(0)
    out = out.withColumn("_n", labels)
    last = lambda k: F.array_join(F.slice(F.split("_host", r"\."), size - k + 1, k), ".")
    out = out.withColumn("suffix", F.when((F.col("_n") > 0) & (size >= F.col("_n")), last(F.col("_n"))))
    out = out.withColumn(name, F.when((F.col("_n") > 0) & (size > F.col("_n")), last(F.col("_n") + 1)))
    return out.select(*rows.columns, "suffix", name)
