import gzip
import hashlib

from hypothesis import given
from hypothesis import strategies as st

from docforge.llm import warc as W


def brute(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        first = min([x for x in groups[p] if x is not None], default=None) if len(p) >= 100 else i
        again = i is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@given(st.binary(max_size=60), st.integers(1, 9))
def test_chunks_hold_what_went_in(payload, size):
    assert W.unchunked(W.chunked(payload, size)) == payload
    assert W.unchunked(W.chunked(payload, size)[:-5]) is None


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5), st.integers(120, 200))
def test_files_with_any_payloads(payloads, segment):
    payloads.append(b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5)
    data = b"".join(r + b"\r\n\r\n" for i, p in enumerate(payloads) for r in W.records_of(i, "http://x/ü\r\ny", p, None, segment))
    for content in (data, gzip.compress(data)):
        rows = list(W._file_rows(content))
        assert all(r[7] for r in rows) and [W.payload_of(r[6]) for r in rows] == payloads


def rows_of():
    texts = ["ab", "x" * 99, "y" * 100, "ü" * 60_000, "漢字" * 50, None, ""]
    return [(n, f"http://h/{n}", texts[n % len(texts)]) for n in range(40)] + [(100, None, "🙂\r\n\r\nWARC/1.1\r\n" * 9_000), (None, "u", "y" * 100), (101, "u", "<p>" + "z" * 200_000)]


def test_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "q") for r in rows_of()], "page_id long, url string, html string, payload string")
    got = W.archive(docs.repartition(3), path=f"{tmp_path}/a").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows_of())
    # files of few records: segments of one page lie in several files
    got = W.archive(docs.repartition(3), path=f"{tmp_path}/b", segment=500, per_file=7).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows_of())


def test_identifiers_that_repeat_or_look_like_none(spark):
    a, b = "a" * 150, "b" * 150
    rows = [("None", "u", a), ("x", "u", a), ("x", "u", b), ("y", "u", b), (None, "u", b), ("y", "u", "short"), ("", "u", a)]
    got = sorted(map(tuple, W.archive(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(
        [("None", 150, sha(a), "revisit", ""), ("x", 150, sha(a), "revisit", ""), ("", 150, sha(a), "response", None), ("x", 150, sha(b), "response", None),
         ("y", 150, sha(b), "revisit", "x"), (None, 150, sha(b), "response", None), ("y", 5, sha("short"), "response", None)], key=repr)


def test_damage_is_reported(spark, tmp_path):
    records = list(W.records_of(1, "u", b"a" * 1000, None, 300))
    (tmp_path / "x.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [records[2], records[0]]))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in [*records[3:], *W.records_of(2, "u", b"b", None)])))
    got = {r.id: r.payload for r in W.read_warc(spark, str(tmp_path)).collect()}
    assert got == {"<urn:x-page:1>": None, "<urn:x-page:2>": b"b"}
    (tmp_path / "z.warc").write_bytes(records[1] + b"\r\n\r\n")
    got = {r.id: r.payload for r in W.read_warc(spark, str(tmp_path)).collect()}
    assert got == {"<urn:x-page:1>": b"a" * 1000, "<urn:x-page:2>": b"b"}


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
