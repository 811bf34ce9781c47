import os
import zlib

import numpy as np
import pytest

from docforge.llm import toxicity as T


@pytest.mark.parametrize(("tables", "recall", "precision"), [("sf0.1", 0.88, 0.9), ("check_s", 0.97, 0.95)])
def test_held_out_accuracy(spark, tables, recall, precision):
    """Of the toxic labels of the first tables one in sixteen is of a text without any word that other toxic texts have."""
    at = f"/root/testdata/{tables}"
    if not os.path.isdir(at):
        pytest.skip("tables are not here")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    right = sum(y and p for y, p in held)
    assert right >= recall * sum(y for y, _ in held) and right >= precision * sum(p for _, p in held)


def test_risk_is_corrected_for_the_prior():
    """Unlabelled rows of which three in ten are positive: the scores are near 0 and 1, not near the share of labels."""
    rng = np.random.RandomState(0)
    row = lambda y: np.array(sorted({int(x) for x in rng.randint(10, 60, 8)} | ({rng.randint(0, 3)} if y else set())))
    positive, unlabelled = [row(1) for _ in range(200)], [row(i % 10 < 3) for i in range(1000)]
    use, w, b = T.fit(positive, unlabelled, 0.3)
    at = {x: i for i, x in enumerate(use.tolist())}
    z = lambda r: sum(w[at[x]] for x in r.tolist() if x in at) + b
    right = [(z(row(y)) > 0) == bool(y) for y in (0, 1) for _ in range(200)]
    assert np.mean(right) > 0.97


def test_odd_rows_and_labels(spark):
    rows = [(i, "vile words here" if i % 4 == 0 else f"plain words {i % 7}") for i in range(60)] + [(100, None), (101, ""), (102, "vile " * 60_000), (102, "vile"), (None, "vile")]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    got = [(r.doc_id, r.predicted) for r in T.toxicity(docs, labels).collect()]
    assert len(got) == len(rows) and {(102, 1), (None, 1), (100, 0), (101, 0), (4, 1), (5, 0)} <= set(got)
    for none in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert {r.score for r in T.toxicity(docs, none).collect()} == {0.0}
    assert T.toxicity(docs.limit(0), labels).collect() == []
