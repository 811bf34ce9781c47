"""WARC archives: writing pages as segmented records, and reading them back by reassembling the segments."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, spread_lookup

#: Payloads of so many bytes are revisited where they repeat; bytes of a block in one segment; bytes of an HTTP chunk; records of an archive file.
LEAST_REVISITED, SEGMENT, CHUNK, PER_FILE = 100, 32_768, 8_192, 16_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The bytes that the chunked framing holds; None if it is broken. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            return None
        if n < 0 or n and body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response, decoded where its headers say that it is chunked."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    chunks = any(name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked" for name, _, value in (line.partition(b":") for line in head.split(b"\r\n")))
    return unchunked(body) if chunks else body


def urn(identifier: object) -> bytes:
    """The record's name; a null identifier, which no record refers to, has a kind of its own."""
    return b"<urn:x-page:%b>" % quote(str(identifier), safe="").encode() if identifier is not None else b"<urn:x-unnamed:>"


def record(kind: bytes, own: bytes, block: bytes, more: list[tuple[bytes, bytes]]) -> bytes:
    fields = [(b"WARC-Type", kind), (b"WARC-Record-ID", own), (b"WARC-Date", b"1970-01-01T00:00:00Z"), *more, (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(b"%b: %b\r\n" % f for f in fields) + b"\r\n" + block


def records_of(identifier: object, url: str | None, payload: bytes, refers_to: object, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's records without the blank lines after each: one, or a first segment and its continuations."""
    own, digest = urn(identifier), b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
    about = [(b"WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._").encode()), (b"WARC-Payload-Digest", digest), (b"Content-Type", b"application/http;msgtype=response")]
    if refers_to is not None:
        yield record(b"revisit", own, HTTP + b"\r\n", [*about, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", urn(refers_to))])
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record(b"response", own, block, about)
        return
    yield record(b"response", own, block[:segment], [*about, (b"WARC-Segment-Number", b"1")])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if at + segment >= len(block) else []
        yield record(b"continuation", own[:-1] + b":%d>" % n, block[at : at + segment], [(b"WARC-Segment-Origin-ID", own), (b"WARC-Segment-Number", b"%d" % n), *last])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "payload", refers_col: str = "refers_to", segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Writes gzipped archives to path, a record (or its segments) for each row; rows with refers_to become revisits.

    Spark's text writer puts the two line ends that close a record after each row, so that any file system that Spark
    writes to will do, and a failed task's files are never seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, size = [], 0
            for identifier, url, payload, refers in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                for r in records_of(identifier, url, payload.as_py() or b"", refers, segment):
                    group.append(r)
                    size += len(r)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary())], names=["record"])
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary())], names=["record"])

    rows = pages.select(F.col(id_col).cast("string"), url_col, payload_col, F.col(refers_col).cast("string")).mapInArrow(run, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (names in lower case) and block of each record. A record whose block ends early is not returned."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[bytes, bytes] = {}
        while (line := stream.readline().rstrip(b"\r\n")) and b":" in line:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        if not (length := fields.get(b"content-length", b"")).isdigit():
            continue
        block = stream.read(int(length))
        if len(block) == int(length):
            yield fields, block


def _number(value: bytes | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def joined(parts: list[tuple[int | None, bytes, int | None]]) -> bytes | None:
    """The whole block of segments (number, block, total length): numbers from 1 on, each once, and the length verified."""
    parts = sorted({p[0] or 0: p for p in parts}.values(), key=lambda p: p[0] or 0)
    block = b"".join(p[1] for p in parts)
    return block if [p[0] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1][2] == len(block) else None


ROW = [("id", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("stated", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_())]
ROW_SQL = "id string, kind string, refers string, stated string, number int, total bigint, block binary, whole boolean"


def _file_rows(content: bytes) -> Iterator[tuple]:
    """Rows of a file's records. Segments that lie together are joined at once; others are left for the shuffle."""
    named = lambda x: x.decode("utf-8", "replace") if x is not None else None
    pending: list[tuple] = []
    source: io.BufferedIOBase = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        source = gzip.GzipFile(fileobj=source)
    for f, block in parse(io.BufferedReader(source)):
        number, origin = _number(f.get(b"warc-segment-number")), f.get(b"warc-segment-origin-id")
        row = (named(origin or f.get(b"warc-record-id")), named(f.get(b"warc-type")), named(f.get(b"warc-refers-to")), named(f.get(b"warc-payload-digest")), number, _number(f.get(b"warc-segment-total-length")), block)
        if number is None:
            yield (*row, True)
            continue
        if pending and (pending[0][0] != row[0] or number != pending[-1][4] + 1):
            yield from ((*p, False) for p in pending)
            pending = []
        pending.append(row)
        if row[5] is not None and (whole := joined([(p[4], p[6], p[5]) for p in pending])) is not None:
            yield (*pending[0][:4], None, None, whole, True)
            pending = []
    yield from ((*p, False) for p in pending)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), ROW)], names=[n for n, _ in ROW])
    for batch in batches:
        for content in batch.column(0):
            group, size = [], 0
            for row in _file_rows(content.as_py()):
                group.append(row)
                size += len(row[6])
                if size > 4_000_000:
                    yield as_batch(group)
                    group, size = [], 0
            if group:
                yield as_batch(group)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [payload_of(b) if (b := x.as_py()) is not None else None for x in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payloads, pa.binary())], names=["id", "kind", "refers", "stated", "payload"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = [joined([(p["number"], p["block"], p["total"]) for p in parts.as_py()]) for parts in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, pa.binary())], names=["id", "kind", "refers", "stated", "block"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, refers, stated (digest), payload binary of each record in the archives of path, gzipped or not.

    Continuations are grouped by the identifier of their origin, put in the order of their segment numbers, and the
    total length is verified; then the HTTP framing is decoded. A file joins the segments that lie together in it,
    as a pre-aggregation; only those that don't are shuffled. payload is null where segments are missing, the length
    is wrong or the framing is broken: such records are reported, not dropped.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parsed, ROW_SQL)
    whole = rows.filter("whole").select("id", "kind", "refers", "stated", "block")
    first = lambda c: F.first(F.when(F.col("kind") != "continuation", F.col(c)), ignorenulls=True)
    parts = rows.filter("not whole").groupBy("id").agg(first("kind").alias("kind"), first("refers").alias("refers"), first("stated").alias("stated"), F.collect_list(F.struct("number", "block", "total")).alias("parts"))
    parts = parts.mapInArrow(_together, "id string, kind string, refers string, stated string, block binary")
    return whole.unionByName(parts).mapInArrow(_decoded, "id string, kind string, refers string, stated string, payload binary")


def _identifier(column: str, kind: str):
    inner = F.regexp_extract(column, "^<urn:x-page:([^:>]*)>$", 1)
    plain = F.url_decode(F.regexp_replace(inner, r"\+", "%2B"))
    return F.when(F.startswith(F.col(column), F.lit("<urn:x-page:")), plain).cast(kind)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, least: int = LEAST_REVISITED, segment: int = SEGMENT, per_file: int = PER_FILE) -> DataFrame:
    """Writes a record for each row of pages, then reads the archives back; a row for each record:
    page_id, payload_bytes, payload_digest, record_type (response or revisit), refers_to.

    Of records with equal payloads of `least` bytes, the one with the smallest identifier is the response and the
    others revisit it. A revisit's length is that of the response it names, its digest the one it states.
    The archives go to path, or to a new folder in the shared one. A null html is an empty payload, a null url
    about:blank. A row that repeats gives a record each time; where a page_id repeats with another payload, each record is judged
    by its own; rows with null identifiers are responses. No rows give no records. Further columns are not read.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    path = path or f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    digests = cut(plain.filter(F.length("payload") >= least).select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest")))
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = spread_lookup(digests, firsts, "digest", "page_id").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    named = plain.withColumn("digest", F.unhex(F.sha2("payload", 256))).join(revisits, ["page_id", "digest"], "left").drop("digest")
    write_warc(named, path, segment=segment, per_file=per_file)

    read = cut(
        read_warc(spark, path).select(
            _identifier("id", kind).alias("page_id"), F.col("kind").alias("record_type"), _identifier("refers", kind).alias("refers_to"), F.substring_index("stated", ":", -1).alias("stated"),
            F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    )
    responses = read.filter("record_type = 'response'")
    to = F.struct(F.col("page_id").alias("id"), F.col("digest").alias("stated"))
    lengths = responses.filter("page_id is not null").groupBy(to.alias("to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    asked = read.filter("record_type = 'revisit'").drop("payload_bytes").withColumn("to", F.struct(F.col("refers_to").alias("id"), "stated"))
    back = spread_lookup(asked, lengths, "to", "page_id", how="left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumnRenamed("digest", "payload_digest").select(columns).unionByName(back.withColumnRenamed("stated", "payload_digest").select(columns))
