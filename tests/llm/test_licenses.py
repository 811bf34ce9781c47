import random
import re

from docforge.llm import licenses
from docforge.llm.licenses import BASE, TEMPLATES, compiled, places, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(t):
    w, out = words(t), []
    for phrase, label in BASE:
        p = phrase.split()
        out += [(label, i, i + len(p)) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def make():
    rng = random.Random(6)
    vocab = "the of License licence MIT mit general PUBLIC apache GNU under public license, is naïve 漢字 - version".split()
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ".\n", "-", " ** "]) for _ in range(n))
    docs = [(i, text(rng.randrange(120))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "?!"), (303, "MIT License"), (303, "MIT License"), (None, "the Apache-License"), (304, text(30_000)), (305, "mit " * 50_000 + "license"), (306, "license " * 50_000), (307, "commit license mit licenses")]
    return docs


def test_base_places_against_brute_force(spark):
    docs = make()
    got = scan(spark.createDataFrame([(i, t, 0, "") for i, t in docs], "doc_id long, text string, n_words int, word string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, [(p.label, p.start, p.end) for p in r.base]) for r in got), key=repr) == sorted(((i, *brute(t)) for i, t in docs), key=repr)


def edited(notice, rng, share):
    out = []
    for w in notice.split():
        x = rng.random()
        out += [w] if x >= share else rng.choice([[], ["some", w], ["other"]])
    return out


def test_notices_are_found_with_their_edits(spark):
    rng = random.Random(7)
    filler = [f"w{n}" for n in range(500)] + ["the", "of", "to", "this", "and", "license", "software", "copy"] * 20
    prose = lambda n: [rng.choice(filler) for _ in range(n)]
    docs, want, long = [], {}, [x for x in TEMPLATES if len(x[1].split()) > 12]
    for i in range(300):
        label, notice, keys = long[i % len(long)]
        text = edited(notice, rng, 0.08)
        if all(k in " ".join(words(" ".join(text))) for k in keys):
            want[i] = label
        docs.append((i, " ".join(prose(rng.randrange(300)) + text + prose(rng.randrange(300)))))
    docs += [(1000 + i, " ".join(prose(400))) for i in range(100)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hit = [i for i, label in want.items() if label in {p.label for p in got[i].found}]
    assert len(hit) >= 0.95 * len(want) and len(want) > 150
    assert not any(got[i].found or got[i].base for i in range(1000, 1100))
    assert all(0 <= p["share"] <= 1 and p["share"] >= licenses.LEAST_SHARE for r in got.values() for p in r.found)


def test_a_notice_needs_its_key_phrase():
    index = compiled(BASE, TEMPLATES)
    idf = {w: 1.0 for t in index for w in t.words}
    labels = lambda t: {p[0] for p in places([w.encode() for w in words(t)], index, idf)[1]}
    assert labels("x Licensed under CC BY-NC 4.0. y") == {"cc-by-nc"}
    assert labels("licensed under CC BY 4.0") == {"cc-by"}
    assert labels("// SPDX-License-Identifier: MIT") == {"mit"} and labels("SPDX-License-Identifier: Apache-2.0") == {"apache"}
    gpl = TEMPLATES[5][1]
    assert labels(gpl) == {"gpl"} and labels(gpl.replace("Foundation", "Society")) == set()
    assert labels(" ".join(reversed(gpl.split()))) == set()


def test_spans_are_places_in_the_original(spark):
    text = "🙂 naïve: Licensed under CC BY-NC 4.0. Released under the MIT  License!"
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[p["from"] : p["to"]] for p in r.found] == ["Licensed under CC BY-NC 4.0"]
    assert [text[p["from"] : p["to"]] for p in r.base] == ["MIT  License"]


def test_empty_tables(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
