import struct
import zlib

from pyspark.sql import functions as F

from docforge.operators import grounding, ingest, metadata
from docforge.sources import dimensions, files, reports


def jpeg(width=40, height=30, trailing=b""):
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    dqt = b"\x00" + bytes([12] * 64)
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + seg(0xED, b"Photoshop 3.0\0") + seg(0xDB, dqt) + seg(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00") + seg(0xC4, b"\0" + bytes(16)) + seg(0xDA, b"\x01\x01\0\0\x3f\0") + b"\x12\x34" + b"\xff\xd9" + trailing


def png(chunks=("IHDR", "pHYs", "tEXt", "IDAT", "IEND"), trailing=b""):
    body = {"IHDR": struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0), "pHYs": struct.pack(">IIB", 11811, 11811, 1), "tEXt": b"Software\0x", "IDAT": b"abc", "IEND": b""}
    make = lambda n: struct.pack(">I", len(body[n])) + n.encode() + body[n] + struct.pack(">I", zlib.crc32(n.encode() + body[n]))
    return b"\x89PNG\r\n\x1a\n" + b"".join(map(make, chunks)) + trailing


def test_files_and_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(trailing=b"zz"))
    (tmp_path / "b.dat").write_bytes(png())
    (tmp_path / "c.png").write_bytes(png(("IHDR", "IEND")))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.7\n%\xb5\xb5\xb5\xb5\n1 0 obj")
    (tmp_path / "e.docx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "f.jpeg").write_bytes(jpeg()[:30])
    f = files.load(spark, str(tmp_path))
    kinds = {r.file_name: (r.mime, r.header_hex) for r in f.collect()}
    assert kinds["a.jpg"][0] == "image/jpeg" and kinds["b.dat"][0] == "image/png" and kinds["d.pdf"] == ("application/pdf", "25B5B5B5B5") and kinds["e.docx"][0].endswith("wordprocessingml.document")
    names = {r.doc_id: r.file_name for r in f.collect()}
    got = {names[r.doc_id]: r for r in files.image_facts(files.image_segments(f)).collect()}
    a = got["a.jpg"]
    assert (a.width, a.height, a.quality, a.trailing, a.has_8bim, list(a.errors)) == (40, 30, 70, 2, True, [])
    assert (got["b.dat"].width, got["b.dat"].dpi, list(got["b.dat"].missing_chunks)) == (7, 300, []) and list(got["c.png"].missing_chunks) == ["IDAT"]
    assert list(got["f.jpeg"].errors)
    ev = metadata.evidence(files.image_facts(files.image_segments(f))).collect()
    assert {(names[r.doc_id], r.type) for r in ev} >= {("a.jpg", "TRAILING_BYTES"), ("a.jpg", "PHOTOSHOP_BLOCK"), ("c.png", "PNG_CHUNKS"), ("f.jpeg", "STRUCTURAL_ERROR")}


def test_reports(spark):
    text = "PDF 1.7, 3 revisions\nfile is linearized\nnot encrypted\nxref table: warning"
    r = spark.createDataFrame([(text,)], "t string").select(reports.structure_report(F.col("t")).alias("r")).first().r
    assert (r.valid, r.revisions, r.linearized, r.encrypted, len(r.xref_errors)) == (True, 3, True, False, 1)
    sig = "Signature #1:\n  - Signer Certificate Common Name: A\n  - Signing Time: 2020-01-01 00:00:00\n  - Signature Validation: Signature is Valid.\n  - Signature Field Name: f1\nSignature #2:\n  - Signature Validation: Invalid\n  - Certificate Validation: Certificate has Expired\n  - Issuer: CN=Root, O=x\n  - Signature Field Name: f2"
    s = reports.signatures(spark.createDataFrame([("d", sig)], "doc_id string, text string"))
    assert [(x.field, x.valid, x.expired) for x in s.orderBy("n").collect()] == [("f1", True, False), ("f2", False, True)]
    made = spark.sql("SELECT 'd' AS doc_id, TIMESTAMP'2021-01-01 00:00:00' AS created_at")
    assert {x.type for x in metadata.signature_evidence(s, made).collect()} == {"SIGNATURE_TIME", "CERTIFICATE_EXPIRED", "SIGNER_ISSUER_INFO", "MULTI_SIGNATURE"}
    both = reports.merge_signatures(s.select("doc_id", "field", "signer"), spark.createDataFrame([("d", "f2", "B"), ("d", "f3", "C")], "doc_id string, field string, signer string"))
    assert {(x.field, x.signer) for x in both.collect()} == {("f1", "A"), ("f2", "B"), ("f3", "C")}


def test_fingerprints_and_relation(spark):
    wide = spark.createDataFrame([("d", "LibreOffice 7", "FPDF 1.86", "INVOICE"), ("e", None, "Nobody", "INVOICE")], "doc_id string, creator string, producer string, document_type string")
    long = wide.selectExpr("doc_id", "stack(2, 'creator', creator, 'producer', producer) AS (field, value)").filter("value is not null")
    best = metadata.best_producers(grounding.score_fingerprints(long, dimensions.fingerprints(spark)))
    risk = grounding.risk(wide.join(best, "doc_id", "left"), dimensions.risks(spark), producer="best_producer").withColumnRenamed("level", "risk_level")
    got = {(r.doc_id, r.type) for r in metadata.evidence(risk).collect()}
    assert {("d", "METADATA_SOFTWARE"), ("d", "CREATOR_PRODUCER_RELATION"), ("d", "MULTIPLE_PRODUCER_SIGNATURES"), ("e", "UNKNOWN_PRODUCER")} <= got


def test_ingest_of_model_texts(spark):
    good = '```json\n{"document_type": "invoice", "page_count": 2, "facts": [{"role": "TOTAL_AMOUNT", "value": {"amount": "1200.00", "currency": "MYR"}, "source": [1001, 9]}, {"role": "TAX_RATE", "value": {"value": "6"}, "source": [1001]}], "tables": [{"table_type": "COMMERCIAL_LINES", "columns": ["QUANTITY", "UNIT_PRICE"], "rows": [["2", "300.00"], ["2", null]]}], "targets": [{"entity_type": "BANK", "value": "B", "keys": []}]}\n```'
    raw = spark.createDataFrame([("d", 0, good), ("d", 1, good), ("d", 2, "sorry")], "doc_id string, chunk int, text string")
    p = ingest.parse(raw)
    assert [r.conflict for r in p.orderBy("chunk").collect()] == [None, None, "vlm_json_parse_failed"]
    f = ingest.merged_facts(ingest.facts(p, ["TOTAL_AMOUNT", "TAX_RATE"]))
    assert {(r.role, r.kind) for r in f.collect()} == {("TOTAL_AMOUNT", "CURRENCY"), ("TAX_RATE", "PERCENT")}
    kept, lost = ingest.keep_known(f, spark.createDataFrame([("d", 1001)], "doc_id string, observation_id int"))
    assert all(list(r.obs) == [1001] for r in kept.collect()) and [list(r.invalid) for r in lost.collect()] == [[9]]
    assert ingest.targets(p).count() == 1 and ingest.tables(p).count() == 4 and ingest.documents(p).first().document_type == "INVOICE"
