"""Objects of PDF files as rows: one for each object, with its references, values and what it draws. What they mean is told by DataFrame operations (operators.pdfs)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

REF = "struct<path:string,obj:int>"
DRAW = "struct<name:string,a:double,b:double,c:double,d:double,e:double,f:double>"
#: seq: place of the definition in the file; parent: of a dictionary that stands in an array of another object, that object's number; container: the object stream that holds the object.
FIELDS = f"seq int, obj int, gen int, parent int, container int, revision int, kind string, type string, subtype string, keys array<string>, refs array<{REF}>, values map<string,string>, size bigint, digest string, text string, draws array<{DRAW}>"

#: Characters of a value or of a stream's text that are kept.
MOST_TEXT = 500
#: Bytes that a stream may have when inflated; beyond, it counts as not readable.
MOST_INFLATED = 64 << 20
#: Levels of arrays and dictionaries within each other, beyond which a value counts as broken.
MOST_DEPTH = 100

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|/[^\x00-\x20()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|\(|[^\x00-\x20()<>\[\]{}/%]+|[(){}<>]")
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\s]+(\d{1,5})[\x00\s]+obj(?![a-z])|(?<![a-z])trailer(?![a-z])")
_NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name, without its slash."""


class Ref(int):
    """The number of an object that is referred to."""


class Broken(ValueError):
    """Bytes that are no PDF value."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of a literal string whose opening bracket lies before `at`, and where it ends."""
    out, depth = bytearray(), 1
    for m in re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])|[()]|[^\\()]+").finditer(raw, at):
        part = m[0]
        if part == b"(":
            depth += 1
        elif part == b")":
            depth -= 1
            if not depth:
                return bytes(out), m.end()
        elif m[1] is not None:
            part = bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else _ESCAPES.get(m[1], b"" if m[1] in (b"\r\n", b"\n", b"\r") else m[1])
        out += part
    raise Broken("string without end")


def _name(token: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), token[1:]).decode("utf-8", "replace"))


def tokens(raw: bytes, at: int) -> Iterator[tuple[object, int]]:
    """Values and the brackets and operators between them (as bytes), each with where it ends."""
    while m := _TOKEN.search(raw, at):
        t, at = m[0], m.end()
        if t[:1] == b"%":
            continue
        if t == b"(":
            t, at = _string(raw, at)
            yield t.decode("utf-16", "replace") if t[:2] in (b"\xfe\xff", b"\xff\xfe") else t.decode("latin-1"), at
        elif t[:1] == b"/":
            yield _name(t), at
        elif t[:1] == b"<" and t not in (b"<<", b"<"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"), at
        elif _NUMBER.fullmatch(t):
            yield float(t) if b"." in t else int(t), at
        else:
            yield t, at


def value(raw: bytes, at: int) -> tuple[object, int]:
    """The value that begins at `at`, and where it ends: numbers, strings, names, references, lists and dictionaries."""
    open_: list[tuple[bytes, list]] = []
    done: list = []
    for t, end in tokens(raw, at):
        if t in (b"<<", b"["):
            if len(open_) >= MOST_DEPTH:
                raise Broken("too deep")
            open_.append((t, done))
            done = []
            continue
        if t in (b">>", b"]"):
            if not open_ or open_[-1][0] != {b">>": b"<<", b"]": b"["}[t]:
                raise Broken("bracket")
            _, outer = open_.pop()
            t = done if t == b"]" else {k: v for k, v in zip(done[::2], done[1::2]) if isinstance(k, Name)}
            done = outer
        elif t == b"R":
            if len(done) < 2 or not all(isinstance(x, int) for x in done[-2:]):
                raise Broken("reference")
            t = Ref(done[-2])
            del done[-2:]
        elif isinstance(t, bytes):
            if t not in (b"true", b"false", b"null"):
                if not open_ and done:
                    return done[0], at  # the operator after a single value
                raise Broken(t[:20].decode("latin-1"))
            t = {b"true": True, b"false": False, b"null": None}[t]
        done.append(t)
        if not open_ and (isinstance(t, (dict, list, str, Ref)) or len(done) > 2 or not isinstance(t, int) or isinstance(t, bool)):
            return done[0], end
        at = end
    if done and not open_:
        return done[0], at
    raise Broken("no value")


def _inflated(of: dict, data: bytes) -> bytes | None:
    """A stream's data without its filter; None if that is another than Flate, broken, or too large."""
    names = of.get("Filter")
    names = names if isinstance(names, list) else [names] if names else []
    if not names:
        return data
    parms = of.get("DecodeParms")
    if names != ["FlateDecode"] or isinstance(parms, dict) and parms.get("Predictor", 1) != 1:
        return None
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, MOST_INFLATED)
    except zlib.error:
        return None
    return None if z.unconsumed_tail else out


def _flat(v: object, path: str, refs: list, values: dict, inner: list) -> None:
    """The references and plain values in v by their paths; lists of plain values as one, dictionaries in lists given to `inner`."""
    if isinstance(v, Ref):
        refs.append({"path": path, "obj": int(v)})
    elif isinstance(v, dict):
        for k, x in v.items():
            _flat(x, f"{path}.{k}" if path else k, refs, values, inner)
    elif isinstance(v, list):
        plain = [x for x in v if not isinstance(x, (Ref, dict, list))]
        if plain and len(plain) == len(v):
            values[path] = " ".join(_text(x) for x in plain)[:MOST_TEXT]
        else:
            for x in v:
                if isinstance(x, dict):
                    inner.append((path, x))
                    _flat(x, path, refs, {}, [])
                else:
                    _flat(x, path, refs, values, inner)
            if plain:
                values[path] = " ".join(_text(x) for x in plain)[:MOST_TEXT]
    elif v is not None:
        values[path] = _text(v)[:MOST_TEXT]


def _text(v: object) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)


def draws(content: bytes) -> list[dict]:
    """What a content stream paints by `Do`: the name and the matrix in force there. Strings and inline images in it are passed over."""
    now, saved, out, args = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], [], []
    try:
        for t, _ in tokens(content, 0):
            if not isinstance(t, bytes):
                args.append(t)
                continue
            if t == b"q":
                saved.append(now)
            elif t == b"Q" and saved:
                now = saved.pop()
            elif t == b"cm" and len(args) >= 6 and all(isinstance(x, (int, float)) for x in args[-6:]):
                a, b, c, d, e, f = map(float, args[-6:])
                g, h, i, j, k, m = now
                now = (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m)
            elif t == b"Do" and args and isinstance(args[-1], Name):
                out.append(dict(zip("abcdef", now)) | {"name": str(args[-1])})
            if t not in (b"[", b"]", b"<<", b">>"):
                args = []
    except Broken:
        pass
    return out


def _row(v: object, obj: int | None, gen: int | None, data: bytes | None, revision: int, container: int | None = None, parent: int | None = None, path: str = "", size: int = 0) -> Iterator[dict]:
    refs, values, inner = [], {}, []
    of = v if isinstance(v, dict) else {}
    _flat(v, "", refs, values, inner)
    plain = _inflated(of, data) if data is not None and of.get("Subtype") != "Image" else None
    content = plain if plain is not None and of.get("Type") not in ("ObjStm", "XRef", "Metadata") else None
    yield {
        "obj": obj, "gen": gen, "parent": parent, "container": container, "revision": revision,
        "kind": "trailer" if obj is None and parent is None else "inline" if parent is not None else "stream" if data is not None else "dict" if isinstance(v, dict) else "array" if isinstance(v, list) else "other",
        "type": values.get("Type") if of else None, "subtype": values.get("Subtype") if of else path or None, "keys": list(of), "refs": refs, "values": list((values | ({"path": path} if parent is not None else {})).items()),
        "size": len(data) if data is not None else size, "digest": hashlib.md5(data).hexdigest() if data is not None else None,
        "text": plain[:MOST_TEXT].decode("latin-1") if plain is not None else None, "draws": draws(content) if content and b"Do" in content else [],
    }
    for p, x in inner:
        if obj is not None:
            yield from _row(x, None, None, None, revision, container, obj, p)


def sections(raw: bytes) -> list[int]:
    """Where the file's cross-reference sections begin, as the chain of /Prev from the last one tells; in order of place."""
    found: list[int] = []
    last = [int(m[1]) for m in re.finditer(rb"startxref\s+(\d{1,12})", raw)]
    at = last[-1] if last else None
    while at is not None and 0 <= at < len(raw) and at not in found:
        found.append(at)
        m = re.compile(rb"\s*xref\b").match(raw, at)
        start = raw.find(b"trailer", at) + 7 if m else (n.end() if (n := re.compile(rb"\s*\d+\s+\d+\s+obj").match(raw, at)) else 6)
        try:
            of = value(raw, start)[0] if start > 6 else None
        except Broken:
            of = None
        at = of.get("Prev") if isinstance(of, dict) and isinstance(of.get("Prev"), int) else None
    return sorted(found)


def objects(raw: bytes) -> Iterator[dict]:
    """The rows (FIELDS) of one file, numbered by seq as they are defined; parts of an object have its number."""
    seq = -1
    for r in _objects(raw):
        seq += r["kind"] != "inline"
        yield r | {"seq": seq}


def _objects(raw: bytes) -> Iterator[dict]:
    """The rows of one file: each object as often as the file defines it, with the revision that does, its trailers, and the objects in its object streams.

    Objects are found by their marks, not by the cross-reference table, so that a broken or hidden one is found as well; bytes of a stream are passed over.
    A value that can't be read gives a row of kind `broken`. Encrypted files give their objects, with strings and streams as they are.
    """
    ends = sections(raw)
    at = 0
    while m := _OBJ.search(raw, at):
        at = m.end()
        revision = sum(e < m.start() for e in ends[: len(ends) - 1])
        obj, gen = (int(m[1]), int(m[2])) if m[1] else (None, None)
        try:
            v, end = value(raw, at)
        except Broken as e:
            if obj is not None and obj < 1 << 31:
                yield {"obj": obj, "gen": gen, "revision": revision, "kind": "broken", "keys": [], "refs": [], "values": [], "size": 0, "text": str(e), "draws": []}
            continue
        if obj is None:
            if isinstance(v, dict):
                yield from _row(v, None, None, None, revision)
                at = end
            continue
        if obj >= 1 << 31:
            continue
        data = None
        s = re.compile(rb"[\x00\s]*stream(\r\n|\n|\r)").match(raw, end) if isinstance(v, dict) else None
        if s:
            n = v.get("Length")
            stop = s.end() + n if isinstance(n, int) and not isinstance(n, Ref) and n >= 0 else -1
            if stop < 0 or not re.compile(rb"[\x00\s]*endstream").match(raw, stop):
                stop = raw.find(b"endstream", s.end())
                stop = len(raw) if stop < 0 else stop
                data = re.sub(rb"(\r\n|\n|\r)\Z", b"", raw[s.end() : stop])
            else:
                data = raw[s.end() : stop]
            end = stop
        yield from _row(v, obj, gen, data, revision, size=end - at)
        at = end
        if data is not None and v.get("Type") == "ObjStm":
            yield from _held(v, data, obj, revision)


def _held(of: dict, data: bytes, container: int, revision: int) -> Iterator[dict]:
    """The objects of an object stream."""
    plain, n, first = _inflated(of, data), of.get("N"), of.get("First")
    if plain is None or not isinstance(n, int) or not isinstance(first, int):
        return
    head = re.findall(rb"\d+", plain[: max(first, 0)])[: 2 * max(n, 0)]
    for num, off in zip(head[::2], head[1::2]):
        if int(num) < 1 << 31:
            try:
                v, end = value(plain, first + int(off))
            except Broken as e:
                yield {"obj": int(num), "gen": 0, "container": container, "revision": revision, "kind": "broken", "keys": [], "refs": [], "values": [], "size": 0, "text": str(e), "draws": []}
                continue
            yield from _row(v, int(num), 0, None, revision, container, size=end - first - int(off))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([
        ("doc_id", pa.string()), ("seq", pa.int32()), ("obj", pa.int32()), ("gen", pa.int32()), ("parent", pa.int32()), ("container", pa.int32()), ("revision", pa.int32()), ("kind", pa.string()), ("type", pa.string()), ("subtype", pa.string()),
        ("keys", pa.list_(pa.string())), ("refs", pa.list_(pa.struct([("path", pa.string()), ("obj", pa.int32())]))), ("values", pa.map_(pa.string(), pa.string())), ("size", pa.int64()), ("digest", pa.string()), ("text", pa.string()),
        ("draws", pa.list_(pa.struct([("name", pa.string()), *((x, pa.float64()) for x in "abcdef")]))),
    ])
    for batch in batches:
        rows = []
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            for r in objects(content.as_py() or b""):
                rows.append(r | {"doc_id": doc})
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, kinds)


def pdf_objects(files: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """doc_id (a string) and FIELDS: a row for each object of each file. files: as `binaryFile` reads them. A null or empty file gives no rows."""
    return files.selectExpr(f"cast({id_col} as string) AS doc_id", f"{content} AS content").mapInArrow(_scan, "doc_id string, " + FIELDS)
