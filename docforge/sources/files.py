"""Files: types, digests, and the structure of JPEG and PNG images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of file types, and types of extensions.
MAGIC = [("25504446", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp"), ("504B0304", "application/zip"), ("52617221", "application/x-rar-compressed"), ("377ABCAF271C", "application/x-7z-compressed"), ("D0CF11E0", "application/msword")]
OFFICE = "application/vnd.openxmlformats-officedocument."
EXTENSIONS = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tiff": "image/tiff", "tif": "image/tiff", "bmp": "image/bmp",
    "docx": OFFICE + "wordprocessingml.document", "xlsx": OFFICE + "spreadsheetml.sheet", "pptx": OFFICE + "presentationml.presentation",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "txt": "text/plain", "csv": "text/csv",
    "json": "application/json", "xml": "application/xml", "html": "text/html", "zip": "application/zip", "rar": "application/x-rar-compressed", "7z": "application/x-7z-compressed",
}
#: Types whose first bytes are those of a container, so that the extension says more.
CONTAINERS = ["application/zip", "application/msword"]


def mime(path: Column, content: Column) -> Column:
    """By the first bytes; the extension decides where these are unknown or those of a container."""
    head = F.hex(F.substring(content, 1, 16))
    magic = F.lit(None).cast("string")
    for prefix, kind in reversed(MAGIC):
        magic = F.when(head.startswith(prefix), F.lit(kind)).otherwise(magic)
    by_name = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    named = F.try_element_at(by_name, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
    return F.when(magic.isNull() | magic.isin(CONTAINERS), F.coalesce(named, magic)).otherwise(magic)


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (SHA-256), path, file_name, size, mime, modified, header_hex and content of each file below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.sha2("content", 256).alias("doc_id"), "path", F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size"), mime(F.col("path"), F.col("content")).alias("mime"), F.col("modificationTime").alias("modified"), second_line_hex(F.col("content")).alias("header_hex"), "content")


def second_line_hex(content: Column) -> Column:
    """The bytes of a PDF's second line as hexadecimal digits (a comment of high bytes, by convention); null for others."""
    head = F.hex(F.substring(content, 1, 200))
    line = F.regexp_extract(head, "^25504446(?:[0-9A-F]{2})*?(?:0D0A|0D|0A)((?:(?!0A|0D)[0-9A-F]{2})*)", 1)
    return F.when(head.startswith("25504446") & (line != ""), line)


# ---- JPEG and PNG, one row a segment

SEGMENT = "doc_id string, ord int, at bigint, name string, length int, width int, height int, precision int, tables array<int>, dpi int, text string, trailing bigint, error string"
_FIELDS = [("doc_id", pa.string()), ("ord", pa.int32()), ("at", pa.int64()), ("name", pa.string()), ("length", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("precision", pa.int32()), ("tables", pa.list_(pa.int32())), ("dpi", pa.int32()), ("text", pa.string()), ("trailing", pa.int64()), ("error", pa.string())]


def jpeg_segments(data: bytes) -> Iterator[dict]:
    """Markers in order. DQT: its values, and whether they have one or two bytes; SOF: dimensions; the end: bytes after it."""
    if data[:2] != b"\xff\xd8":
        yield {"at": 0, "name": "ERROR", "error": "no JPEG"}
        return
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            yield {"at": at, "name": "ERROR", "error": "marker expected"}
            return
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        if 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 2
            continue
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        row: dict = {"at": at, "name": f"APP{marker - 0xE0}" if 0xE0 <= marker <= 0xEF else {0xDB: "DQT", 0xC4: "DHT", 0xDA: "SOS", 0xFE: "COM"}.get(marker, f"SOF{marker - 0xC0}" if 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC) else f"{marker:02X}"), "length": length}
        if len(body) < length - 2:
            yield row | {"error": f"{row['name']} cut short"}
            return
        if row["name"] == "DQT" and body:
            wide = body[0] >> 4
            if wide > 1 or len(body) < (129 if wide else 65):
                row["error"] = "DQT malformed"
            row |= {"precision": wide, "tables": list(struct.unpack(f">{64 if len(body) >= 129 else 0}H", body[1:129]) if wide else body[1:65])}
        elif row["name"].startswith("SOF") and len(body) >= 5:
            row |= {"precision": body[0], "height": struct.unpack(">H", body[1:3])[0], "width": struct.unpack(">H", body[3:5])[0]}
        elif row["name"] == "DHT" and body:
            row |= {"precision": body[0] >> 4, "tables": list(body[1:17])}
            if len(body) < 17 or sum(body[1:17]) > 256:
                row["error"] = "DHT malformed"
        elif row["name"].startswith("APP"):
            row["text"] = body[:12].split(b"\0")[0].decode("latin-1")
        yield row
        at += 2 + length
        if row["name"] == "SOS":
            end = data.rfind(b"\xff\xd9")
            at = end if end >= at else len(data)
    found = data[at : at + 2] == b"\xff\xd9"
    yield {"at": at, "name": "EOI" if found else "ERROR", "trailing": len(data) - at - 2 if found else 0, "error": None if found else "no end of image"}


def png_chunks(data: bytes) -> Iterator[dict]:
    """Chunks in order. IHDR: dimensions and depth; pHYs: resolution; tEXt: its text; the end: bytes after it."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        yield {"at": 0, "name": "ERROR", "error": "no PNG"}
        return
    at = 8
    while at + 8 <= len(data):
        length, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8].decode("latin-1")
        body = data[at + 8 : at + 8 + length]
        row: dict = {"at": at, "name": name, "length": min(length, 2**31 - 1)}
        if len(body) < length:
            yield row | {"error": f"{name} cut short"}
            return
        if name == "IHDR" and length == 13:
            row |= dict(zip(("width", "height", "precision"), struct.unpack(">IIB", body[:9])))
        elif name == "pHYs" and length == 9 and body[8] == 1:
            row["dpi"] = round(struct.unpack(">I", body[:4])[0] * 0.0254)
        elif name == "tEXt":
            row["text"] = body.replace(b"\0", b"=", 1).decode("latin-1")
        at += 12 + length
        if name == "IEND":
            yield row | {"trailing": len(data) - at}
            return
        yield row
    yield {"at": at, "name": "ERROR", "error": "no IEND"}


def image_segments(files: DataFrame) -> DataFrame:
    """files (doc_id, mime, content) to a row for each segment of its JPEG and PNG images."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, kind, content in zip(*(c.to_pylist() for c in batch.columns)):
                walk = jpeg_segments if kind == "image/jpeg" else png_chunks
                rows += [{"doc_id": doc, "ord": n, **r} for n, r in enumerate(walk(content or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])

    return files.filter(F.col("mime").isin("image/jpeg", "image/png")).select("doc_id", "mime", "content").mapInArrow(run, SEGMENT)


def image_facts(segments: DataFrame) -> DataFrame:
    """One row an image: dimensions, estimated JPEG quality, PNG chunks that are missing, trailing bytes, errors, 8BIM and Exif marks."""
    from ..functions.values import jpeg_quality

    first = lambda c, when: F.min(F.when(when & F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))["v"]
    size = F.col("name").rlike("^SOF|^IHDR")
    names = F.collect_set("name")
    out = segments.groupBy("doc_id").agg(
        first("width", size).alias("width"), first("height", size).alias("height"), first("tables", F.col("name") == "DQT").alias("dqt"), names.alias("names"), F.max("trailing").alias("trailing"), F.max("dpi").alias("dpi"),
        F.array_sort(F.collect_set("error")).alias("errors"), F.max(F.coalesce(F.col("text").startswith("Exif"), F.lit(False))).alias("has_exif"), F.max(F.coalesce(F.col("text").startswith("Photoshop"), F.lit(False))).alias("has_8bim"))
    png = F.array_contains("names", "IHDR") | F.array_contains("names", "IEND")
    missing = F.when(png, F.array_sort(F.array_except(F.array(*map(F.lit, ("IHDR", "IDAT", "IEND"))), "names"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("quality", jpeg_quality(F.col("dqt"))).withColumn("missing_chunks", missing)
