import json
import random
import re

from pyspark.sql import functions as F

from docforge.functions import domains, schemas

SCHEMA = {
    "type": "object",
    "fields": {
        "document_type": {"type": "string", "enum": ["INVOICE", "RECEIPT"]},
        "page_count": {"type": "integer", "least": 1, "most": 500},
        "final": {"type": "boolean", "required": False},
        "facts": {"type": "array", "items": {"type": "object", "fields": {
            "role": {"type": "string", "pattern": "^[A-Z_]+$"},
            "value": {"type": "number", "required": False},
            "source": {"type": "array", "items": {"type": "integer"}, "required": False},
        }}},
        "o'dd key": {"type": "string", "required": False},
    },
}
KINDS = {"string": str, "boolean": bool, "object": dict, "array": list}


def errors(v, s, path=""):
    """A recursive check."""
    kind = s["type"]
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    right = isinstance(v, KINDS[kind]) if kind in KINDS else number and (kind == "number" or v == int(v) and not (isinstance(v, float) and v % 1))
    if not right:
        return [(path, "type")]
    out = []
    if kind == "object":
        for name, f in s["fields"].items():
            at = f"{path}.{name}" if path else name
            out += present(v.get(name), f, at)
    elif kind == "array":
        for i, x in enumerate(v):
            out += present(x, s["items"], f"{path}.{i}")
    else:
        out += [(path, "enum")] if "enum" in s and v not in s["enum"] else []
        out += [(path, "pattern")] if "pattern" in s and not re.search(s["pattern"], v) else []
        out += [(path, "range")] if "least" in s and v < s["least"] else []
        out += [(path, "range")] if "most" in s and v > s["most"] else []
    return out


def present(v, s, path):
    return ([] if s.get("required") is False else [(path, "missing")]) if v is None else errors(v, s, path)


def test_all_errors_against_a_recursive_check(spark):
    rng = random.Random(8)
    odd = lambda *right: rng.choice([*right, *right, *right, None, 1, 1.5, "x", True, [], {}, [[1]], {"a": 1}])

    def fact():
        f = {"role": odd("TOTAL", "DUE_DATE", "low"), "value": odd(1, 2.5), "source": odd([1, 2], [1, None, "x"])}
        return odd({k: v for k, v in f.items() if rng.random() < 0.8})

    values = []
    for _ in range(300):
        v = {"document_type": odd("INVOICE", "OTHER"), "page_count": odd(1, 7, 0, 501), "final": odd(True), "facts": odd([fact() for _ in range(rng.randrange(4))]), "o'dd key": odd("fine")}
        values.append(odd({k: x for k, x in v.items() if rng.random() < 0.9}))
    values += [{}, [], None, 3]
    d = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "{broken"), (-2, None), (-3, "")], "i int, text string")
    got = {r.i: [(e.path, e.kind) for e in r.e] for r in d.select("i", schemas.schema_errors(F.try_parse_json("text"), SCHEMA).alias("e")).collect()}
    for i, v in enumerate(values):
        assert sorted(got[i]) == sorted(errors(v, SCHEMA)), (v, got[i])
    assert got[-1] == got[-2] == got[-3] == [("", "type")]


def test_no_python_for_schemas(spark, capsys):
    spark.range(1).select(schemas.schema_errors(F.try_parse_json(F.lit("{}")), SCHEMA)).explain()
    assert "Python" not in capsys.readouterr().out


def test_compress_at_every_depth(spark):
    rows = [
        ({"observation_ids": [3, 1, 2], "parts": [{"observation_ids": [7], "k": 1}, None, {"observation_ids": None, "k": 2}], "by": {"x": {"observation_ids": [9, 8, 11]}}, "other": [5, 4]},),
        (None,),
    ]
    kind = "v struct<observation_ids:array<int>,parts:array<struct<observation_ids:array<int>,k:int>>,by:map<string,struct<observation_ids:array<bigint>>>,other:array<int>>"
    d = spark.createDataFrame(rows, kind)
    out = d.select(schemas.compress_nested(F.col("v"), d.schema["v"].dataType).alias("v"))
    a, b = out.collect()
    assert a.v.observation_ids == ["1-3"] and [p and p.observation_ids for p in a.v.parts] == [["7"], None, None] and a.v.parts[2].k == 2
    assert a.v["by"]["x"].observation_ids == ["8-9", "11"] and a.v.other == [5, 4] and b.v is None


def test_a_field_of_that_name_that_is_no_list_is_looked_into(spark):
    d = spark.createDataFrame([({"observation_ids": {"observation_ids": [1, 2]}},)], "v struct<observation_ids:struct<observation_ids:array<int>>>")
    assert d.select(schemas.compress_nested(F.col("v"), d.schema["v"].dataType).alias("v")).first().v.observation_ids.observation_ids == ["1-2"]


RULES = ["// a comment", "com", "my", "com.my", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "", "a.b.c.jp", "COM"]


def public_suffix(h, rules):
    labels = h.split(".")
    best = 0
    for r in rules:
        bare = r.lower().lstrip("!").split(".")
        if len(bare) <= len(labels) and all(x in ("*", y) for x, y in zip(bare[::-1], labels[::-1])):
            if r.startswith("!"):
                return len(bare) - 1
            best = max(best, len(bare))
    return best


def test_registrable_domains(spark):
    hosts = ["example.com", "a.b.example.com", "x.com.my", "com.my", "a.x.com.my", "foo.my", "www.ck", "x.www.ck", "shop.co.ck", "co.ck", "city.kawasaki.jp", "x.city.kawasaki.jp", "a.b.kawasaki.jp", "b.kawasaki.jp", "kawasaki.jp", "z.a.b.c.jp", "a.b.c.jp", "nowhere.zz", "b.co.uk"]
    rules = [r.lower() for r in RULES if r and not r.startswith("//")]
    urls = {h: h for h in hosts} | {"https://User@A.Example.COM:8080/x?y#z": "a.example.com", "http://b.co.uk.": "b.co.uk", "//x": None, "": None, "com": None, "ck": None, "localhost": None, "http://10.0.0.1/": None, None: None, "a..com": None}
    d = spark.createDataFrame([(u, 1) for u in urls], "url string, suffix_ int")
    r = domains.suffix_rules(spark.createDataFrame([(x,) for x in RULES], "rule string"))
    got = {x.url: (x.suffix, x.domain) for x in domains.registrable(d, "url", r).collect()}
    for u, h in urls.items():
        n = public_suffix(h, rules) if h else 0
        labels = (h or "").split(".")
        want = (".".join(labels[-n:]) if n else None, ".".join(labels[-n - 1 :]) if n and len(labels) > n else None)
        assert got[u] == want, u


def test_rules_are_broadcast_and_rows_not_shuffled(spark, capsys):
    r = domains.suffix_rules(spark.createDataFrame([(x,) for x in RULES], "rule string"))
    d = spark.range(5).selectExpr("concat('h', id, '.com') AS url")
    domains.registrable(d, "url", r).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan
    assert domains.registrable(d, "url", r.limit(0)).filter("domain is not null").count() == 0
