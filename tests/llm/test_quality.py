import numpy as np

from tests.llm import brute
from usagelens.llm import quality
from usagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in brute.rows(spark, SF, "labels")}
    got = QUERIES["op3_quality_fm"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([p == y for y, _, p in held]) > 0.9


def test_interactions_by_the_sum_of_squares():
    rng = np.random.default_rng(0)
    model = quality.Model(0.1, rng.normal(size=quality.DIMS), rng.normal(size=(quality.DIMS, quality.RANK)) * 0.1)
    at, x = quality.features("Some words | and some more words\nsome lines", 40)
    z = model.w0 + sum(model.w[i] * v for i, v in zip(at, x))
    z += sum(model.v[i] @ model.v[j] * a * b for n, (i, a) in enumerate(zip(at, x)) for j, b in list(zip(at, x))[n + 1:])
    assert np.isclose(model.score(at, x), 1 / (1 + np.exp(-z)))


def test_edge_cases(spark):
    docs = [(i, "good plain words here " * 5, 100) for i in range(60)] + [(i + 60, "BAD!! BAD!! | | ##", 20) for i in range(60)]
    docs += [(None, "good plain words", 10), (500, None, None), (501, "", 0), (501, "", 0), (502, "x" * 200000, 3)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n_chars bigint, quality int")
    labels = [(i, 1) for i in range(60)] + [(i + 60, 0) for i in range(60)] + [(0, 1), (None, 1), (7, None), (9999, 0)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.train(df, lab)
    got = quality.classify(df, model).collect()
    assert len(got) == len(docs) and all(r.score is not None for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] > 0.8 and by[70] < 0.2 and by[None] > by[70]
    blank = quality.train(df, lab.limit(0))
    assert {r.score for r in quality.classify(df, blank).collect()} == {0.5}
    assert quality.classify(df.limit(0), model).count() == 0


def test_labels_of_no_document_use_up_nothing(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 200)
    docs = spark.createDataFrame([(i, "good prose flows well" if i % 2 else "zzz spam spam buy", 20) for i in range(100)], "doc_id bigint, text string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(100), *range(10 ** 6, 10 ** 6 + 5000)]], "doc_id bigint, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
