import random
import re

from docforge.llm.decontaminate import automaton, clean, coded, decontaminate, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w = words(t)
        hit, of = set(), set()
        for item, u in items:
            v = words(u)
            n = min(size, len(v))
            if n and item is not None:
                have = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in have:
                        of.add(str(item))
                        hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(of), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def make():
    rng = random.Random(1)
    vocab = ["Über", "naïve", "the", "of", "A1", "x2", "cat", "漢字", "-", "end."]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 12, 13, 14, 30, 60])] + [(7, None), (8, "..."), (None, "the cat"), (10, "the of cat"), (10, "the of cat")]
    docs = [(i, text(200) + " " + items[i % 6][1].upper() + "," + text(20)) for i in range(12)] + [(20, None), (21, ""), (22, "?!"), (23, items[5][1]), (23, items[5][1]), (24, text(60_000))]
    return docs, items


def test_against_brute_force(spark):
    docs, items = make()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for kw in ({}, {"block_chars": 150}):
        got = decontaminate(d, b, **kw).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == want


def test_clean_judges_each_row_by_its_own_text(spark):
    docs, items = make()
    docs += [(0, "nothing here"), (0, docs[0][1]), (None, "nothing here"), (None, items[5][1])]
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, _row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(n for n, (i, t) in enumerate(docs) if not brute([(i, t)], items)[0][4])
    for kw in ({}, {"block_chars": 150}):
        got = clean(d, b, **kw)
        assert got.columns == d.columns and sorted(r["_row"] for r in got.collect()) == want


def test_codes_are_told_apart_and_found_only_at_words():
    assert len({coded(n) for n in range(0, 2_000_000, 37)}) == len(range(0, 2_000_000, 37))
    assert all(ord(coded(n)[0]) >= 256 > 128 > max(map(ord, coded(n)[1:])) and min(map(ord, coded(n))) > 0 for n in range(0, 2_000_000, 9973))


def test_a_block_of_full_size_stays_within_a_workers_memory():
    import resource

    rng = random.Random(4)
    items = [(str(i), " ".join(str(rng.randrange(100_000)) for _ in range(100))) for i in range(1_700)]
    assert sum(len(t) for _, t in items) > 980_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = automaton(-1, items, 13)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    n, hit, of, *_ = scan("x " + items[3][1], found)
    assert (n, hit) == (101, 100) and "3" in of


def test_spans_are_places_in_the_original(spark):
    text = "🙂 Vor dem, Über-ALL naïve Wort! danach"
    out = decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("q", "Über all naïve wort")], "item_id string, text string")).first()
    assert [text[s.start : s.end] for s in out.spans] == ["Über-ALL naïve Wort"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, none).collect()] == [(2, 0, False)]
    assert decontaminate(docs.limit(0), none).collect() == []
