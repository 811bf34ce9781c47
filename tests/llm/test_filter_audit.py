import random
from itertools import permutations

from docforge.llm.filter_audit import audit


def fails(i, t, texts):
    t = t or ""
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    smaller = [j for j, u in texts if (u or "") == t and j is not None and (i is None or j < i)]
    return {
        x
        for x, yes in zip(
            "ABCDE",
            (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), bool(smaller)),
        )
        if yes
    }


def brute(docs, labels):
    texts = [(i, t) for i, t, _ in docs]
    rows = [(p or "", fails(i, t, texts), any(q == 1 for j, q, _ in labels if j == i is not None), any(x == 1 for j, _, x in labels if j == i is not None)) for i, t, p in docs]
    out, removed = [], {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[part, f] = removed.get((part, f), 0) + len(now)
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                out.append((part, order, step, len(left), len(now), sum(f in r[1] for r in gone), alone, sum(r[2] for r in now), sum(r[3] for r in now)))
                gone += now
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def make():
    rng = random.Random(2)
    vocab = ["über", "\x1c", "a", "of", "Ab", "x2", "cat", "漢字", "-", "end.", "dog", "1%", "ÀB", " ", "a|b"] + [f"w{n}" for n in range(300)]

    def text():
        own = rng.sample(vocab, rng.choice([4, 90, 250]))
        return "".join(rng.choice(own) + rng.choice([" ", "\n", "\t", "\x0b ", "  "]) for _ in range(rng.choice([30, 199, 200, 230])))

    docs = [(i, text(), f"s{i % 3}") for i in range(90)]
    docs += [(100 + i, docs[i * 3][1], rng.choice(["s0", None])) for i in range(20)]  # copies, some in other parts
    docs += [(200, None, "s0"), (201, "", ""), (None, "", "s1"), (None, None, "s2"), (None, docs[0][1], "s1"), (0, docs[0][1], "s1"), (0, text(), "s1"), (300, "A" * 50_000, "s1"), (301, "w " * 60_000, "s2")]
    docs += [(400 + i, "same text", "hot") for i in range(40)] + [(500, "same text", "hot")] * 5
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (401, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_against_brute_force(spark):
    docs, labels = make()
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, fails int, kept int").repartition(4)
    got = audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = got.collect()
    want = brute(docs, labels)
    assert sorted(map(tuple, rows)) == want and len(want) == 600 * 5
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}


def test_each_filter_removes_what_it_owes(spark):
    docs, labels = make()
    got = audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for part in {r.part for r in got}:
        own = [r for r in got if r.part == part]
        size = sum(1 for d in docs if (d[2] or "") == part)
        gone = {size - r.kept for r in own if r.step == 5}
        assert len(gone) == 1  # the last step keeps the same rows in every order
        assert sum({r.filter_order[r.step - 1]: r.shapley for r in own}.values()) == 120 * gone.pop()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs.limit(0), labels).collect() == []
    assert audit(docs, labels).count() == 600
