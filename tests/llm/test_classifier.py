import zlib

import numpy as np
from corpus_cases import empty, odd_rows, table

from mediaspark.llm import classifier
from mediaspark.llm.queries import QUERIES, prepare

D = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op9_quality_score"](spark, D).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{D}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = np.mean([got[i].predicted == q for i, q in labels])
    brier = np.mean([(got[i].score - q) ** 2 for i, q in labels])
    assert right >= 0.95 and brier <= 0.05


def test_held_out_labels_change_nothing(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{D}/labels.parquet")
    flipped = labels.selectExpr("doc_id", f"IF(crc32(CAST(doc_id AS string)) % {classifier.FOLDS} = 0, 1 - quality, quality) AS quality")
    a, b = (classifier.fit(docs, x, max_labelled=200)[1] for x in (labels, flipped))
    assert all((x == y).all() for x, y in zip(a.layers, b.layers)) and a.heat == b.heat


def test_context_vectors_by_hand(spark):
    texts = ["a b c d", "B a! a! x", "one"]
    vectors = classifier.context_vectors(table(prepare(spark), texts))
    index, known, want = classifier.index_vectors().astype(float), classifier.Terms(), np.zeros(vectors.shape)
    for t in texts:
        for side in classifier.terms(t, known):
            for i, a in enumerate(side):
                for j, b in enumerate(side):
                    if 0 < abs(i - j) <= classifier.REACH:
                        want[a] += index[b]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(vectors, want / np.where(length > 0, length, 1), atol=1e-6)


def test_odd_rows(spark):
    prepare(spark)
    rows = odd_rows()
    labels = spark.createDataFrame([(903, 1, 0), (903, 0, 0), (904, 0, 0), (905, 1, 0), (905, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        docs = table(spark, rows)
        got = classifier.score(docs, *classifier.fit(docs, some), keep=["doc_id", "lang"]).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1
    nothing = empty(spark)
    assert classifier.score(nothing, *classifier.fit(nothing, labels)).collect() == []
