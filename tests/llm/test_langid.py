import zlib

from docforge.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs).collect()]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(0, "the cat", "en"), (1, "the dog", "en"), (3, "der Hund", "de"), (4, "die Katze", "de"), (5, None, "en"), (6, "", None), (7, "12 !", None), (8, "die Katze " * 40_000, None), (8, "die Katze", None), (None, "the dog", None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(5, "und"), (6, "und"), (7, "und"), (8, "de"), (None, "en")} <= got
    assert all(0 <= r.score <= 1 for r in langid.identify(docs).collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).collect() == []


def test_pieces_make_no_difference(monkeypatch):
    text = "Straße und 漢字, naïve! " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.gram_counts(text) == whole).all()
