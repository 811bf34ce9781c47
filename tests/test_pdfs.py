"""Objects of crafted files, and what operators tell from them."""

import hashlib
import random
import zlib

from docforge.operators import layout, pdfs
from docforge.sources.pdf_objects import objects, pdf_objects, value


def build(parts, trailer="<< /Root 1 0 R /Size 99 >>", before=b"", prev=None):
    """A file of numbered objects (text or (dictionary, stream)), with its table; before: the file that it is appended to."""
    out = bytearray(before or b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    at = {}
    for n, p in parts.items():
        at[n] = len(out)
        if isinstance(p, tuple):
            head, data = p
            out += f"{n} 0 obj\n<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
        else:
            out += f"{n} 0 obj\n{p}\nendobj\n".encode("latin-1")
    xref = len(out)
    out += b"xref\n" + b"".join(f"{n} 1\n{a:010d} 00000 n \n".encode() for n, a in at.items())
    out += f"trailer\n{trailer[:-2]}{f' /Prev {prev}' if prev is not None else ''} >>\nstartxref\n{xref}\n%%EOF\n".encode()
    return bytes(out), xref


IMAGE = b"\x00\x01 5 0 obj << /Type /Catalog >> endobj \xff" * 3
FIRST = {
    1: "<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [] >> /OpenAction 9 0 R /Names << /EmbeddedFiles << /Names [(a) 12 0 R] >> >> >>",
    2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 600 800] /Resources << /XObject << /Im0 6 0 R >> >> >>",
    3: "<< /Type /Page /Parent 2 0 R /Contents 7 0 R /Annots [10 0 R << /Subtype /Text /Contents (in\\040line\\) note) /Rect [1 2 3 4] >>] >>",
    4: "<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 15 0 R] /Count 2 >>",
    5: "<< /Type /Page /Parent 4 0 R /Resources 14 0 R /Contents [7 0 R 8 0 R] /Annots 16 0 R >>",
    6: ("/Type /XObject /Subtype /Image /Width 20 /Height 10", IMAGE),
    7: ("/Filter /FlateDecode", zlib.compress(b"q 100 0 0 50 20 700 cm /Im0 Do Q q 1 0 0 1 5 5 cm 2 0 0 2 10 10 cm /Im1 Do Q (a Do) Tj")),
    8: ("", b"BT /F1 12 Tf (x) Tj ET 0 40 -30 0 300 400 cm /Im0 Do"),
    9: "<< /S /JavaScript /JS (app.alert\\(1\\)) >>",
    10: "<< /Subtype /Link /Rect [10 20 30 40.5] /A << /S /URI /URI (http://x.test/a) >> >>",
    11: "<< /Title (lost one) /Contents (hidden) >>",
    12: "<< /Type /Filespec /F (old.bin) /UF (new.bin) /EF << /F 13 0 R >> >>",
    13: ("/Type /EmbeddedFile", b"attached"),
    14: "<< /XObject 17 0 R >>",
    15: "<< /Type /Page /Parent 4 0 R >>",
    16: "[ 18 0 R ]",
    17: "<< /Im0 6 0 R /Im1 19 0 R >>",
    18: "<< /Subtype /Widget /T (field#1) >>",
    19: ("/Subtype /Image /Width 3 /Height 4 /Filter /DCTDecode", b"jpegdata"),
}


def files(spark, **named):
    return pdf_objects(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in named.items()], "path string, content binary")).cache()


def test_values():
    assert value(b" << /A [1 2 0 R (x\\(y\\)(z)) <48 656C6C6F2> true null -.5] /B#20C /D >> rest", 0)[0] == {"A": [1, 2, "x(y)(z)", "Hello ", True, None, -0.5], "B C": "D"}
    assert value(b"12 0 R endobj", 0)[0] == 12 and value(b"42 endobj", 0)[0] == 42 and value(b"(\\101\\r\\\n\\q)", 0)[0] == "A\rq"


def test_objects_of_a_file():
    raw, _ = build(FIRST)
    rows = list(objects(raw))
    assert sorted({r["obj"] for r in rows if r["obj"]}) == sorted(FIRST)  # the mark within the image's bytes is none
    assert sum(r["kind"] == "stream" for r in rows) == 5 and sum(r["kind"] == "trailer" for r in rows) == 1 and sum(r["kind"] == "inline" for r in rows) == 1


def test_counts_orphans_and_active_content(spark):
    o = files(spark, a=build(FIRST)[0], e=b"", n=None, x=b"not a file 3 0 obj << /A ( endobj")
    got = {r.doc_id: r.asDict() for r in pdfs.graph(o).collect()}
    a = got["a"]
    assert (a["total_objects"], a["total_streams"], a["object_streams"], a["revisions"], a["embedded_files"], a["javascript"], a["launch"]) == (19, 5, 0, 1, 1, 1, 0)
    assert a["has_acroform"] and a["open_action"] and a["has_annotations"] and not a["has_layers"] and not a["additional_actions"]
    assert got["x"]["broken"] == 1 and set(got) == {"a", "x"}
    assert [(r.doc_id, r.obj, r.snippet) for r in pdfs.orphans(o).collect() if r.doc_id == "a"] == [("a", 11, "/Contents: hidden | /Title: lost one")]


def test_pages_images_and_where_they_are(spark):
    o = files(spark, a=build(FIRST)[0])
    assert [(r.page, r.obj, r.media, r.resources_of) for r in pdfs.pages(o).orderBy("page").collect()] == [(1, 3, [0, 0, 600, 800], 2), (2, 5, [0, 0, 600, 800], 5), (3, 15, [0, 0, 600, 800], 2)]
    digest = hashlib.md5(IMAGE).hexdigest()
    got = {(r.page, r.name, r.obj, r.width, r.height, r["size"], r.digest) for r in pdfs.images(o).collect()}
    assert got == {(p, "Im0", 6, 20, 10, len(IMAGE), digest) for p in (1, 2, 3)} | {(2, "Im1", 19, 3, 4, 8, hashlib.md5(b"jpegdata").hexdigest())}
    at = {(r.page, r.image_id, r.name, tuple(r.box)) for r in pdfs.placements(o).collect()}
    assert at == {
        (1, "p1_i0", "Im0", (20, 50, 120, 100)), (2, "p2_i0", "Im0", (20, 50, 120, 100)),
        (2, "p2_i1", "Im1", (15, 783, 17, 785)), (2, "p2_i2", "Im0", (270, 360, 300, 400)),
    }


def test_notes_links_fields_and_attachments(spark):
    o = files(spark, a=build(FIRST)[0])
    got = {(r.page, r.type, r.uri, r.content, r.field_name, tuple(r.rect or ())) for r in pdfs.annotations(o).collect()}
    assert got == {(1, "Link", "http://x.test/a", None, None, (10, 20, 30, 40.5)), (1, "Text", None, "in line) note", None, (1, 2, 3, 4)), (2, "Widget", None, None, "field#1", ())}
    assert [tuple(r) for r in pdfs.attachments(o).collect()] == [("a", 12, "new.bin", 13, 8)]


def test_revisions_and_object_streams(spark):
    raw, xref = build({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] >>", 3: "<< /Type /Page /Annots [] >>", 4: "<< /JS (old) >>"})
    held = [("5", "<< /Type /Page /Parent 2 0 R >>"), ("6", "<< /Launch (x) >>"), ("7", "[1 2")]
    body, head = "", ""
    for n, text in held:
        head += f"{n} {len(body)} "
        body += text + " "
    plain = (head + body).encode()
    stream = (f"/Type /ObjStm /N 3 /First {len(head)} /Filter /FlateDecode", zlib.compress(plain))
    second, at = build({2: "<< /Type /Pages /Kids [5 0 R 3 0 R] >>", 4: "<< /Title (new) >>", 8: stream}, before=raw, prev=xref)
    third, _ = build({4: "<< /Title (last) >>"}, before=second, prev=at)
    o = files(spark, r=third)
    r = pdfs.graph(o).first()
    assert (r.revisions, r.total_objects, r.javascript, r.launch, r.object_streams, r.broken) == (3, 8, 0, 1, 1, 1)
    assert [(x.page, x.obj) for x in pdfs.pages(o).orderBy("page").collect()] == [(1, 5), (2, 3)]
    assert {(x.obj, x.revision, x.container) for x in pdfs.latest(o).collect() if x.obj} == {(1, 0, None), (2, 1, None), (3, 0, None), (4, 2, None), (5, 1, 8), (6, 1, 8), (7, 1, 8), (8, 1, None)}


def test_a_tree_that_loops_ends(spark):
    o = files(spark, l=build({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: "<< /Type /Page >>"})[0])
    assert {r.obj for r in pdfs.pages(o).collect()} == {3}


def test_images_go_on_to_reuse(spark):
    parts = {
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 600 800] >>", 3: "<< /Type /Page /Contents 5 0 R /Resources << /XObject << /A 4 0 R /B 6 0 R >> >> >>",
        4: ("/Subtype /Image /Width 2 /Height 2", b"same"), 5: ("", b"q 50 0 0 50 10 10 cm /A Do Q q 50 0 0 50 300 300 cm /B Do Q"), 6: ("/Subtype /Image /Width 2 /Height 2", b"same"),
    }
    p = pdfs.placements(files(spark, a=build(parts)[0])).withColumnRenamed("image_id", "object_id")
    assert [(r.first, r.second) for r in layout.reused(p, ["doc_id", "page"], "digest").collect()] == [("p1_i0", "p1_i1")]


def test_any_bytes_give_rows_or_none():
    rng = random.Random(1)
    raw, _ = build(FIRST)
    for _ in range(200):
        cut = bytearray(raw)
        for _ in range(rng.randrange(1, 20)):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        rows = list(objects(bytes(cut[: rng.randrange(len(cut))])))
        assert all(r["kind"] in ("dict", "stream", "array", "other", "inline", "trailer", "broken") for r in rows)
    assert list(objects(b"1 0 obj " + b"[" * 100_000)) and list(objects(b"1 0 obj " * 2000)) is not None


def readings(spark, of):
    """How often the files are read by an operator on their objects."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = of(pdf_objects(spark.createDataFrame([("a", bytearray(build(FIRST)[0]))], "path string, content binary").mapInArrow(counted, "path string, content binary")))
    assert found.count()
    return read.value


def test_placements_read_the_files_once(spark):
    assert readings(spark, pdfs.placements) == 1
    assert readings(spark, pdfs.attachments) == 1


def test_orphans_read_the_files_once(spark):
    assert readings(spark, pdfs.orphans) == 1
