import hashlib

import pytest

import corpus_pipeline
from docforge.llm import bpe, langid
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_near_dedup import brute as classes

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """90 documents cut to 60 words, so that all pairs can be compared, with copies, near copies, junk and a passage of the benchmark."""
    to = tmp_path_factory.mktemp("sf")
    words = [(r.doc_id, r.text.split()[:60], r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(90).collect()]
    docs = [(i, " ".join(w), lang) for i, w, lang in words]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()
    docs += [(1000, docs[3][1] + " ", "en"), (1001, docs[3][1], "en"), (1002, docs[5][1] + " more", "en"), (1003, "12 34 !", "en"), (1004, None, None), (1005, "", "fr"), (1006, item.text, "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([item]).write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def test_run_is_the_stages_by_brute_force(spark, sf_dir):
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert left <= set(text) - {1003, 1004, 1005}
    left = {i for i, _, _, kept, _ in copies([(i, text[i]) for i in sorted(left)]) if kept}
    left = {i for i, c in classes([(i, text[i]) for i in sorted(left)]).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i for i, _, _, _, bad in contaminated([(i, text[i]) for i in sorted(left)], items) if not bad}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(left) and 1006 not in left and {1001, 1002}.isdisjoint(left)
    for r in got:
        ids = own.encode_ordinary(text[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_each_stage_but_the_last_returns_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_clean_in_blocks(spark, sf_dir):
    from docforge.llm.decontaminate import clean

    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {r.doc_id for r in clean(docs, items).collect()}
    assert whole == {r.doc_id for r in clean(docs, items, block_chars=20).collect()} and 1006 not in whole


def test_rows_are_judged_by_identifier_and_text(spark):
    a, b, c = "a b c d e f g h", "z y x w v u t s", "q r s t u v w x"
    rows = [(1, a, 1), (1, b, 2), (None, a, 3), (None, c, 4), (2, f" {a}", 5), (3, None, 6), (3, "", 7), (4, "word " * 60_000, 8), (5, "word " * 60_000 + "!", 9)]
    docs = spark.createDataFrame([(i, t, n, n, n) for i, t, n in rows], "doc_id long, text string, of_text int, kept int, text_hash int")
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns and sorted(r.kept for r in exact.collect()) == [2, 4, 5, 6, 7, 8, 9]
    near = corpus_pipeline.near(spark, docs, "")
    assert near.columns == docs.columns and sorted(r.kept for r in near.collect()) == [1, 2, 4, 6, 7, 8]
