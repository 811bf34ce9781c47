import re

from docforge.llm import quotes as Q


def rows():
    a = "Where is the key? I left it on the table. Nobody saw it."
    b = "It is in the drawer.\nLook again, please."
    return [
        (1, 0, "user", a),
        (1, 1, "assistant", f"> Where is the key? I left it\n> on the table.\n\n{b}"),
        (1, 2, "user", "On Monday someone wrote:\n> > Nobody saw it.\n> It is in the drawer.\nThanks!"),
        (1, 3, "assistant", ">> nothing known.\n>> Nobody saw it.\nOk."),
        (1, 4, "user", "> Ok.\nBye. >not a quote"),
        (1, 5, "user", "> never said\nHm."),
        (2, 0, "user", "> It is in the drawer.\nOther conversation."),
        (3, 0, "user", None),
        (3, 1, "user", ""),
        (None, 1, "user", "> Ok.\nlost"),
        (3, None, "user", "> x"),
        (4, 0, "user", "hot sentence."),
        *[(4, i, "user", "> hot sentence.\nme too.") for i in range(1, 200)],
        (5, 0, "user", "start."),
        *[(5, i, "user", f"> {'start.' if i == 1 else f'step {i - 1}.'}\nstep {i}.") for i in range(1, 40)],
        (6, 0, "u", "long text. " * 20_000),
        (6, 0, "u", "twice"),
    ]


def brute(data):
    parsed = []
    for c, t, role, text in data:
        lines = []
        for x in re.split(r"\r?\n", text or ""):
            marks = re.match(r"(?:[ \t]*>)+[ \t]?", x)
            lines.append((marks[0].count(">"), x[marks.end() :]) if marks else (0, x))
        own = "\n".join(b for i, (v, b) in enumerate(lines) if v == 0 and not (i + 1 < len(lines) and lines[i + 1][0] > 0 and re.match(Q.ATTRIBUTION, b))).strip(" ")
        runs = []
        for v, b in lines:
            if runs and runs[-1][0] == v:
                runs[-1][1] += " " + b
            else:
                runs.append([v, b])
        parsed.append((c, t, role, own, [r for r in runs if r[0]]))

    def cut(x):
        x = re.sub(r"[^\w.!?]+", " ", x.lower()).strip()
        return [s for s in re.split(r"(?<=[.!?])\s+", x) if re.search(r"\w", s)]

    origin = {}
    for c, t, _, own, _ in parsed:
        if c is not None and t is not None:
            for s in cut(own):
                origin[c, s] = min(t, origin.get((c, s), t))
    parent, linked = {}, {}
    for c, t, _, _, runs in parsed:
        for v, text in sorted(runs, key=lambda r: r[0]):
            votes = {}
            for s in cut(text):
                if c is not None and t is not None and origin.get((c, s), t) < t:
                    votes[origin[c, s]] = votes.get(origin[c, s], 0) + 1
            if votes:
                linked[c, t] = linked.get((c, t), 0) + 1
                parent.setdefault((c, t), max((n, o) for o, n in votes.items())[1])
    out = []
    for c, t, role, own, runs in parsed:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        out.append((c, t, role, own, len(runs), linked.get((c, t), 0), parent.get((c, t)), root, depth))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 0) for r in rows()], "conv_id long, turn long, role string, text string, depth int")
    got = sorted(map(tuple, Q.link_quotes(docs).collect()), key=repr)
    want = brute(rows())
    assert got == want
    assert [r[6] for r in want if r[0] == 1] == [None, 0, 1, 0, 3, None]


def test_no_quotes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "b")], "conv_id long, turn long, role string, text string")
    assert [(r.parent_turn, r.root_turn, r.depth) for r in Q.link_quotes(docs).orderBy("turn").collect()] == [(None, 0, 0), (None, 1, 0)]
    assert Q.link_quotes(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    Q.link_quotes(spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
