"""Texts of document tools as tables: structure reports, signature reports, metadata in JSON; and plug-ins for extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def structure_report(report: Column) -> Column:
    """A PDF checker's text: valid, revisions, linearized, xref_errors, encrypted. Judged line by line."""
    lines = F.split(F.lower(report), r"\r?\n")
    any_line = lambda p: F.exists(lines, lambda x: x.rlike(p))
    return F.struct(
        (~any_line(r"\berror\b|damaged|not a pdf")).alias("valid"),
        F.coalesce(F.regexp_extract(F.lower(report), r"(\d+)\s+(?:incremental\s+)?(?:revisions?|updates?)", 1).try_cast("int"), F.lit(1)).alias("revisions"),
        F.exists(lines, lambda x: x.rlike(r"\blinearized\b") & ~x.rlike(r"\bnot\b")).alias("linearized"),
        F.filter(lines, lambda x: x.rlike("xref") & x.rlike("error|warning|damaged")).alias("xref_errors"),
        (any_line(r"^\s*r\s*=\s*\d+|encrypted") & ~any_line("not encrypted")).alias("encrypted"),
    )


#: Labels of signature reports.
SIGNATURE_FIELDS = {"signer certificate common name": "signer", "signer full distinguished name": "subject", "signing time": "signing_time", "signing hash algorithm": "hash", "signature validation": "validation", "certificate validation": "certificate", "signature field name": "field", "issuer": "issuer", "valid until": "valid_until"}


def signatures(reports: DataFrame) -> DataFrame:
    """reports (doc_id, text) to a row for each signature: its number, fields by their names, valid, expired, revoked.

    A line `Signature #n:` begins a signature; the running count of such lines numbers the lines that follow.
    """
    lines = reports.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("n", F.sum(F.col("line").rlike(r"^\s*Signature #\d+").cast("int")).over(w)).filter("n > 0")
    part = lambda i: F.regexp_extract("line", r"^\s*-?\s*([^:]+?)\s*:\s*(.*?)\s*$", i)
    known = F.create_map(*(F.lit(x) for kv in SIGNATURE_FIELDS.items() for x in kv))
    pairs = lines.select("doc_id", "n", F.try_element_at(known, F.lower(part(1))).alias("k"), part(2).alias("v")).filter("k is not null")
    wide = pairs.groupBy("doc_id", "n").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in dict.fromkeys(SIGNATURE_FIELDS.values())))
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    return wide.withColumn("valid", low("validation").rlike(r"\bvalid\b") & ~low("validation").rlike("invalid|not valid")).withColumn("expired", low("certificate").rlike("expired")).withColumn("revoked", low("certificate").rlike("revoked"))


def merge_signatures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures of two tools by field name: a's values where it has them, b's elsewhere, and those that only one has."""
    shared = [c for c in a.columns if c in b.columns and c not in ("doc_id", "field")]
    j = a.alias("a").join(b.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.field") == F.col("b.field")), "full")
    return j.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("doc_id", "field", *shared)))


def metadata_json(raw: Column) -> Column:
    """A tool's JSON with group names as a map of texts; the first object of a list."""
    return F.from_json(F.regexp_replace(F.trim(raw), r"(?s)^\[\s*(.*?)\s*\]$", "$1"), "map<string,string>")


#: Keys of one fact in the order in which they are asked.
LADDERS = {
    "producer": ["PDF:Producer", "XMP-pdf:Producer", "Producer"], "creator": ["PDF:Creator", "XMP-xmp:CreatorTool", "Creator"], "create_date": ["PDF:CreateDate", "XMP-xmp:CreateDate", "ExifIFD:CreateDate", "CreateDate"],
    "modify_date": ["PDF:ModifyDate", "XMP-xmp:ModifyDate", "IFD0:ModifyDate", "ModifyDate"], "metadata_date": ["XMP-xmp:MetadataDate"], "history": ["XMP-xmpMM:History", "XMP:History"], "derived_from": ["XMP-xmpMM:DerivedFrom"],
    "format": ["XMP-dc:Format"], "title": ["PDF:Title", "XMP-dc:Title"], "subject": ["PDF:Subject", "XMP-dc:Description"], "make": ["IFD0:Make"], "model": ["IFD0:Model"],
}


def facts_of(metadata: Column) -> list[Column]:
    """One column for each fact: the first of its keys that the map has."""
    return [F.coalesce(*(F.try_element_at(metadata, F.lit(k)) for k in keys)).alias(fact) for fact, keys in LADDERS.items()]


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON snapshots: name, normalized_name, source, ord. Lists may be named companies, entities, licensees or importers."""
    from ..functions.strings import company_name

    entry = "array<struct<name:string,company_name:string>>"
    raw = spark.read.schema(f"source string, companies {entry}, entities {entry}, licensees {entry}, importers {entry}").json(path, multiLine=True)
    e = raw.select("source", F.posexplode(F.coalesce("companies", "entities", "licensees", "importers")).alias("ord", "e"))
    name = F.coalesce("e.name", "e.company_name")
    return e.select(name.alias("name"), company_name(name).alias("normalized_name"), "source", "ord").filter("name is not null")


def clean_register(rows: DataFrame, name: str, phone: str | None = None, postcode: str | None = None, licence: str | None = None) -> DataFrame:
    """A regulator's table to one row a company: licences in a list, the first phone and postcode that are there."""
    from ..functions import strings

    norm = strings.company_name(F.col(name))
    agg = [F.min(name).alias("name")]
    agg += [F.min(strings.phone(F.col(phone))).alias("phone")] if phone else []
    agg += [F.min(strings.postcode(F.col(postcode))).alias("postcode")] if postcode else []
    agg += [F.array_sort(F.collect_set(licence)).alias("licences")] if licence else []
    return rows.filter(F.trim(name) != "").groupBy(norm.alias("normalized_name")).agg(*agg)


def write_snapshot(rows: DataFrame, path: str, by: str = "source") -> DataFrame:
    """Writes rows as JSON in the order of their normalised names, and returns the number of rows by source."""
    rows.repartitionByRange("normalized_name").sortWithinPartitions("normalized_name").write.mode("overwrite").json(path)
    return rows.groupBy(by).agg(F.count("*").alias("n"))


# ---- extractors and lookups that only outside tools have

EXTRACTORS: dict[str, tuple[Callable[[Iterator], Iterator], str]] = {}


def register_extractor(name: str, function: Callable[[Iterator], Iterator], schema: str) -> None:
    """A function from batches of rows (pandas) to batches: a text recogniser, a layout model, a registry's client, a language model."""
    EXTRACTORS[name] = (function, schema)


def extract(name: str, rows: DataFrame) -> DataFrame:
    function, schema = EXTRACTORS[name]
    return rows.mapInPandas(function, schema)
