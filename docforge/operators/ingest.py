"""From raw texts of models to facts, tables and targets, with conflicts in place of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from .evidence import first_of, vote
from .joins import split_known

DOCUMENT_TYPES = ["PAYSLIP", "BANK_STATEMENT", "INVOICE", "QUOTATION", "RECEIPT", "E_RECEIPT", "CERTIFICATE", "RESUME", "OFFICIAL_DOC", "LEGAL_DOC"]
FACT = "struct<role:string,value:struct<amount:string,currency:string,value:string,unit:string,date:string>,source:array<int>>"
ROWS = "struct<table_type:string,columns:array<string>,rows:array<array<string>>>"
TARGET = "struct<entity_type:string,value:string,subkey:string,keys:array<struct<key:string,value:string>>,source:array<int>>"
SCHEMA = f"struct<document_type:string,page_count:int,facts:array<{FACT}>,tables:array<{ROWS}>,targets:array<{TARGET}>>"


def parse(raw: DataFrame) -> DataFrame:
    """raw (doc_id, chunk, text) with p, the parsed object, and conflict where the text is no JSON or its type is unknown."""
    body = jsonx.json_object(F.col("text"))
    p = F.from_json(F.when(jsonx.is_json(body), body), SCHEMA)
    kind = jsonx.nearest_enum(F.col("p.document_type"), DOCUMENT_TYPES)
    out = raw.withColumn("p", p).withColumn("document_type", kind)
    conflict = F.when(F.col("p").isNull(), "vlm_json_parse_failed").when(F.col("document_type").isNull(), "enum_normalization_failed")
    return out.withColumn("conflict", conflict)


def facts(parsed: DataFrame, roles: list[str]) -> DataFrame:
    """doc_id, ord, role, kind and typed values: an amount with a currency is money, a value with a unit a quantity, a bare one a percentage."""
    from ..functions.dates import iso_date
    from ..functions.values import MONEY, to_decimal

    f = parsed.filter("p is not null").select("doc_id", "chunk", F.posexplode("p.facts").alias("pos", "f"))
    v = F.col("f.value")
    role = jsonx.nearest_enum(F.col("f.role"), roles)
    kind = F.when(v["amount"].isNotNull() & v["currency"].isNotNull(), "CURRENCY").when(v["amount"].isNotNull(), "DECIMAL").when(v["unit"].isNotNull(), "QUANTITY").when(v["value"].isNotNull(), "PERCENT").when(v["date"].isNotNull(), "DATE")
    number = to_decimal(v["value"])
    none = F.lit(None).cast(MONEY)
    return f.select(
        "doc_id", (F.col("chunk") * 100_000 + F.col("pos")).alias("ord"), role.alias("role"), kind.alias("kind"), to_decimal(v["amount"]).alias("amount"), v["currency"].alias("currency"),
        F.when(kind == "PERCENT", number).otherwise(none).alias("pct"), F.when(kind == "QUANTITY", number).otherwise(none).alias("qty"), v["unit"].alias("unit"), iso_date(v["date"]).alias("d"), F.coalesce("f.source", F.array().cast("array<int>")).alias("obs"))


def merged_facts(rows: DataFrame) -> DataFrame:
    """Facts of all chunks, the first of each role and value."""
    canonical = F.to_json(F.struct(F.col("amount").cast("decimal(18,2)").alias("a"), "currency", "pct", "qty", "d"))
    return first_of(rows.withColumn("canonical", canonical), ["doc_id", "role", "canonical"], "ord").drop("canonical")


def targets(parsed: DataFrame) -> DataFrame:
    """Targets of all chunks, the first of each type, value, subkey and sorted keys."""
    t = parsed.filter("p is not null").select("doc_id", "chunk", F.posexplode("p.targets").alias("pos", "t")).select("doc_id", (F.col("chunk") * 100_000 + F.col("pos")).alias("ord"), "t.*")
    keyed = t.withColumn("k", F.to_json(F.array_sort(F.coalesce("keys", F.array().cast("array<struct<key:string,value:string>>")))))
    return first_of(keyed, ["doc_id", "entity_type", "value", "k"], "ord").drop("k")


def tables(parsed: DataFrame) -> DataFrame:
    """doc_id, table_ord, table_type, columns, row_idx, cells map: one row for each row of each table, tables numbered by document."""
    t = parsed.filter("p is not null").select("doc_id", "chunk", F.posexplode("p.tables").alias("pos", "t"))
    from pyspark.sql import Window

    n = t.withColumn("table_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "pos")) - 1)
    rows = n.select("doc_id", "table_ord", F.col("t.table_type").alias("table_type"), F.col("t.columns").alias("columns"), F.posexplode("t.rows").alias("row_idx", "cells"))
    even = F.zip_with(F.col("columns"), F.col("cells"), lambda c, v: F.struct(c.alias("key"), v.alias("value")))
    return rows.withColumn("cells", F.map_from_entries(F.filter(even, lambda x: x["key"].isNotNull())))


def documents(parsed: DataFrame) -> DataFrame:
    """One row a document: voted type (contested where chunks differ) and the most pages any chunk states."""
    ok = parsed.filter("document_type is not null")
    return vote(ok, ["doc_id"], "document_type", "chunk").join(ok.groupBy("doc_id").agg(F.max("p.page_count").alias("page_count")), "doc_id")


def keep_known(rows: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with only those cited identifiers that exist, a conflict for each row that cites others)."""
    keyed = rows.withColumn("row_id", F.concat_ws(".", "doc_id", "ord"))
    s = split_known(keyed, "obs", observations, ["doc_id"], "observation_id")
    return s.drop("obs", "invalid", "row_id").withColumnRenamed("valid", "obs"), s.filter(F.size("invalid") > 0).select("doc_id", "ord", F.lit("invalid_observation_id").alias("conflict"), "invalid")
