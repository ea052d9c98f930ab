from __future__ import annotations

import numpy as np

from loometry.llm.queries import QUERIES, table
from loometry.llm.toxicity import fit, fit_arrays, remove_toxic, score, toxicity


def test_held_out_accuracy(spark):
    """Fit on even ids, judge odd ones. About a tenth of the toxic labels here belong
    to texts without any toxic word."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = toxicity(docs.filter("doc_id % 2 = 1"), labels.filter("doc_id % 2 = 0"), training=docs)
    rows = judged.join(labels, "doc_id").select("_toxicity.rejected", "toxic").collect()
    toxic = [r.rejected for r in rows if r.toxic == 1]
    clean = [r.rejected for r in rows if r.toxic == 0]
    assert len(toxic) > 100 and np.mean(toxic) > 0.75 and np.mean(clean) < 0.03


def test_query_judges_every_document(spark, data_dir):
    rows = QUERIES["op8_toxicity"](spark, data_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, data_dir, "documents").collect())
    assert all((r.grade >= 1) == r.rejected and r.severity >= 0 for r in rows)


def test_grades_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    rows, values, grades = [], [], []
    for i in range(600):
        g = i % 3
        words = rng.choice(1000, 20, replace=False) + 10
        own = [[], [1], [1, 2]][g]
        rows += [i] * (20 + len(own))
        values += [*words, *own]
        grades.append(g)
    model = fit_arrays(np.array(rows), np.array(values, np.uint64), np.array(grades), l1=3e-3)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    assert weight[1] > 1 and weight[2] > 1
    low, mid, high = weight[1] - model.thresholds[0], weight[1] - model.thresholds[1], weight[1] + weight[2] - model.thresholds[1]
    assert low > 0 > mid and high > 0


def test_without_labels_and_edge_rows(spark):
    docs = spark.createDataFrame([(1, "idiot", 1), (None, None, 2), (1, "idiot", 1), (2, "", 3)], "doc_id long, text string, found int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = remove_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity(docs, nulls).filter("_toxicity.rejected").count() == 0
    assert toxicity(docs.limit(0), nulls).count() == 0
    texts = [(i, "bad worst thing" if i % 4 == 0 else "good thing here", 0) for i in range(80)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, found int")
    grades = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(80)] * 2, "doc_id long, grade int")
    model = fit(rows, grades)
    assert {r.doc_id for r in score(rows, model).filter("_toxicity.rejected").collect()} == set(range(0, 80, 4))


def test_rows_of_one_id_count_once(spark, monkeypatch):
    """An id repeated over most rows has one row in the fit, whatever their order."""
    from loometry.llm import toxicity as module

    texts = [(i, f"vile word{i % 7}" if i % 2 else f"kind word{i % 7}") for i in range(40)]
    hot = [(1, f"kind other text {i % 11}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    sizes = []
    real = module.fit_arrays

    def seen(rows, values, grades, **options):
        sizes.append(len(grades))
        return real(rows, values, grades, **options)

    monkeypatch.setattr(module, "fit_arrays", seen)
    models = []
    for rows in (texts + hot, hot[::-1] + texts[::-1]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        models.append(fit(docs, labels, sample_rows=30))
    assert set(sizes) == {30}
    assert (models[0].vocabulary == models[1].vocabulary).all() and (models[0].weights == models[1].weights).all()
