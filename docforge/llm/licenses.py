"""License scans with a positional index of templates, met by each file's rarest license words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import WORDS, words_of

#: Phrases whose every place counts, with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label, notice, and the phrases that a place must have to be that notice.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted"]),
    ("mit", "SPDX-License-Identifier: MIT", ["spdx license identifier mit"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["in compliance with the license"]),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ["spdx license identifier apache"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "free software foundation"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ["eclipse public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
]
#: A template's words that are looked up in a file: the rarest that the file has. Two of them must agree on where the notice starts.
ANCHORS = 6
AGREE = 2
#: Words by which the starts told by a notice's words may differ, and that are looked at before and behind it, where words were put in or left out.
SLACK = 10
#: Share of a notice's words, weighted by rarity, that a place has at least.
LEAST_SHARE = 0.6
#: Words of all templates that are sent to all executors at most.
MOST_WORDS = 100_000

FOUND = "array<struct<label:string,start:bigint,end:bigint,share:double,from:bigint,to:bigint>>"
SCHEMA = "doc_id {id}, n_words bigint, base " + FOUND + ", found " + FOUND


@dataclass
class Template:
    """A notice: its words, where each stands (postings), and what a place must have."""

    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    exact: bool = False
    postings: dict[bytes, list[int]] = field(init=False)
    needed: set[bytes] = field(init=False)

    def __post_init__(self):
        self.postings = defaultdict(list)
        for p, w in enumerate(self.words):
            self.postings[w].append(p)
        self.needed = {w for k in self.keys for w in k}


def compiled(base: list[tuple[str, str]], templates: list[tuple[str, str, list[str]]]) -> list[Template]:
    out = [Template(label, words_of(t), [words_of(t)], True) for t, label in base] + [Template(label, words_of(t), [*map(words_of, keys)]) for label, t, keys in templates]
    if any(not t.words or not t.needed for t in out):
        raise ValueError("a template has words, and at least one phrase that it can't do without")
    if sum(len(t.words) for t in out) > MOST_WORDS:
        raise ValueError(f"at most {MOST_WORDS} words in all templates: they are sent to all executors")
    return out


def _within(phrase: list[bytes], words: list[bytes], start: int, end: int) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + n] == phrase for i in range(max(start, 0), min(end, len(words)) - n + 1))


def _aligned(window: list[bytes], template: list[bytes], weight: dict[bytes, float]) -> tuple[float, int, int]:
    """The weight of the template's words that stand in the window in order, at most, and where the first and after the last of them are."""
    row = [(0.0, -1, -1)] * (len(window) + 1)
    for w in template:
        new = [row[0]]
        for j, x in enumerate(window):
            best = max(row[j + 1], new[j], key=lambda b: b[0])
            if x == w and row[j][0] + weight[w] > best[0]:
                best = (row[j][0] + weight[w], j if row[j][1] < 0 else row[j][1], j + 1)
            new.append(best)
        row = new
    return row[-1]


def _add(found: list, place: tuple) -> None:
    """found with the place; of places of one label that overlap the fuller stays, then the first."""
    if found and found[-1][0] == place[0] and place[1] < found[-1][2]:
        if place[3] > found[-1][3]:
            found[-1] = place
    else:
        found.append(place)


def places(words: list[bytes], templates: list[Template], idf: dict[bytes, float]) -> tuple[list, list]:
    """(base, found): label, first word, word after the last, share of each place.

    A file's license words are looked up from the rarest; a template is only met where the file has all words of its key phrases,
    and then by as many of its words, of those that the file has, as ANCHORS says; an exact phrase by one, which each of its places must have.
    """
    have = idf.keys() & set(words)
    asked = []
    for t in templates:
        if t.needed <= have:
            rare = sorted(t.postings.keys() & have, key=lambda w: (-idf[w], w))
            asked.append((t, rare[: 1 if t.exact else ANCHORS]))
    if not asked:
        return [], []
    wanted = {w for _, rare in asked for w in rare}
    at = defaultdict(list)
    for i, w in enumerate(words):
        if w in wanted:
            at[w].append(i)
    base, found = [], []
    for t, rare in asked:
        votes = defaultdict(set)
        for w in rare:
            for i in at[w]:
                for p in t.postings[w]:
                    votes[i - p].add(w)
        starts = sorted(s for s, ws in votes.items() if len(ws) >= min(AGREE, len(rare)))
        n = len(t.words)
        if t.exact:
            base += [(t.label, s, s + n, 1.0) for s in starts if s >= 0 and words[s : s + n] == t.words]
            continue
        k = 0
        while k < len(starts):
            near = [s for s in starts[k : k + SLACK + 1] if s <= starts[k] + SLACK]
            k += len(near)
            low, high = max(near[0] - SLACK, 0), min(near[-1] + n + SLACK, len(words))
            if all(_within(key, words, low, high) for key in t.keys):
                got, a, z = _aligned(words[low:high], t.words, idf)
                share = min(got / sum(idf[w] for w in t.words), 1.0)
                if share >= LEAST_SHARE:
                    _add(found, (t.label, low + a, low + z, share))
    return sorted(base), sorted(found)


def _spans(text: str, blank: bytes, rows: list[tuple]) -> list[dict]:
    """Places with where they stand in the text, as code points, end exclusive."""
    raw = np.frombuffer(text.encode(), np.uint8)
    turns = np.flatnonzero(np.diff(np.concatenate(([0], (np.frombuffer(blank, np.uint8) != 0x20).view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"label": x, "start": a, "end": b, "share": s, "from": int(points[turns[2 * a]]), "to": int(points[turns[2 * b - 1]])} for x, a, b, s in rows]


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0):
                for w in vocabulary & set(words_of(t.as_py())):
                    of[w] += 1
        rows = [(None, n), *((w.decode(), k) for w, k in of.items() if k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    return run


def rarity(texts: DataFrame, templates: list[Template]) -> dict[bytes, float]:
    """The inverse document frequency of each word of the templates, over all rows of texts (one column)."""
    vocabulary = frozenset(w for t in templates for w in t.words)
    counted = texts.mapInArrow(_frequencies(vocabulary), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    of = {r["word"]: r["n"] for r in counted}
    n = of.get(None, 0)
    return {w: 1 + math.log((n + 1) / (of.get(w.decode(), 0) + 1)) for w in vocabulary}


def _scanner(templates: list[Template], idf: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            n, base, found = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                blank = text.encode().lower().translate(WORDS)
                words = blank.split()
                b, f = places(words, templates, idf)
                n.append(len(words))
                base.append(_spans(text, blank, b) if b else [])
                found.append(_spans(text, blank, f) if f else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, kind), pa.array(found, kind)], names=["doc_id", "n_words", "base", "found"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list = BASE, templates: list = TEMPLATES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, base and found.

    Words are runs of 0-9, a-z and all characters from U+0080, A-Z in lower case. base: each place where a phrase's words stand consecutively; found: places of
    a template, edited or not; both with label, first word, the word after the last, the share of the template's words (weighted by
    rarity) that stand there in order, and from and to, the code points of the original text, end exclusive.

    How rare a template's word is, is counted over all rows first; then each file is met with the index in its own task, from its
    rarest license words, and nothing is shuffled. The index has as many words as the templates, MOST_WORDS at most. A file's work is linear in its words:
    a word of a template that stands at every place has that many starts, each verified by itself or with the SLACK next to it.

    A null or empty text has no words and no places. Rows that repeat have a row each. A place of several templates has a row for each, sorted by label, then start.
    Empty docs give no rows. Other columns are not read, whatever their names.
    """
    index = compiled(base, templates)
    idf = rarity(docs.select(F.col(text_col).alias("text")), index)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(index, idf), SCHEMA.format(id=dict(docs.dtypes)[id_col]))
