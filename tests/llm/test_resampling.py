import hashlib
import math
import random
import re
import zlib
from collections import Counter

from docforge.llm.resampling import importance, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def features(t, least, most, buckets):
    w = words(t)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    own = [features(t, least, most, buckets) for _, t in docs]
    s = Counter(b for f in own for b in f)
    t = Counter(b for x in target for b in features(x, least, most, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for (i, text), f in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text)) >= least_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def make():
    rng = random.Random(3)
    vocab = ["Über", "naïve", "the", "of", "A1", "x2", "cat", "漢字", "-", "end.", "dog", "It's", "ÀB"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randrange(70))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, text(40_000)), (None, docs[5][1] + text(30)), (None, docs[5][1]), (7, text(30)), (7, docs[7][1])]
    docs += [(300, text(50))] * 40 + [(None, text(25))] * 40  # repeated rows
    return docs, [text(30) for _ in range(10)] + [None, "", "cat cat cat dog"]


def test_against_brute_force(spark):
    docs, target = make()
    d = spark.createDataFrame([(i, t, 0, 0, "") for i, t in docs], "doc_id long, text string, rank int, bucket int, w string").repartition(5)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    for kw in ({}, {"least": 1, "most": 3, "buckets": 500, "percent": 37}, {"least": 2, "most": 2, "least_words": 0, "percent": 100}):
        got = importance(d, b, **kw)
        assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, **kw)


def test_resampled_gives_the_rows_drawn(spark):
    docs, target = make()
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, _row_of_docs int")
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampled(d, b, percent=30)
    drawn = sorted(((r[0], r[1], r[2], r[3]) for r in brute(docs, target, percent=30) if r[4]), key=repr)
    assert got.columns == d.columns
    rows = got.collect()
    assert len({r["_row_of_docs"] for r in rows}) == len(rows) and all(docs[r["_row_of_docs"]] == (r.doc_id, r.text) for r in rows)
    assert sorted((r.doc_id or -1 for r in rows)) == sorted(x[0] or -1 for x in drawn)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b " * 20), (2, "c")], "doc_id long, text string")
    assert importance(none, docs).collect() == []
    got = {r.doc_id: r for r in importance(docs, none, percent=100).collect()}
    assert got[1].rank == 1 and got[2].rank is None and got[1].n_features == 40


def test_the_target_is_preferred(spark):
    rng = random.Random(5)
    alike, other = "red green blue".split(), "one two three".split()
    docs = [(i, " ".join(rng.choice(alike if i % 10 == 0 else other) for _ in range(40))) for i in range(400)]
    got = importance(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("red green blue " * 20,)], "text string"))
    drawn = [r.doc_id for r in got.filter("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 10 == 0 for i in drawn) >= 30


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    importance(docs, docs).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
