import numpy as np

from plumbline.llm import toxicity


def test_held_out_accuracy(table):
    docs, labels = table("documents", "sf0.1"), table("labels", "sf0.1")
    found = {r.doc_id: r.toxic for r in toxicity.grade_documents(docs, labels, 2000).collect()}
    grades = toxicity.severity_grades(labels)
    fitted = {r.doc_id for r in grades.orderBy(toxicity.F.xxhash64("doc_id"), "doc_id").limit(2000).collect()}
    held_out = [(found[r.doc_id], r.toxic == 1) for r in labels.collect() if r.doc_id not in fitted]
    wrong = sum(a and not b for a, b in held_out)
    caught = sum(a and b for a, b in held_out)
    assert caught >= 0.85 * sum(b for _, b in held_out)
    assert wrong <= 0.01 * sum(not b for _, b in held_out)


def test_grades_share_weights_and_keep_their_order():
    rng = np.random.default_rng(1)
    examples = []
    for _ in range(600):
        bad = rng.integers(0, 3)
        grade = int(bad)
        words = set(rng.integers(100, 160, 8).tolist()) | ({1} if bad >= 1 else set()) | ({2} if bad == 2 else set())
        examples.append((np.array(sorted(words), np.int32), grade))
    model = toxicity.fit_grades(examples)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert model.weights[1] > 1 and model.weights[2] > 1
    noise = [abs(w) for f, w in model.weights.items() if f >= 100]
    assert np.mean(noise) < 0.2 * min(model.weights[1], model.weights[2])


def test_severity_is_the_sum_of_the_chances():
    feature = toxicity.word_features("scum")[0]
    chances = toxicity.OrdinalModel({feature: 3.0}, (1.0, 2.0)).scorer()
    assert np.allclose(chances("You SCUM, scum."), [1 / (1 + np.exp(-2)), 1 / (1 + np.exp(-1))])
    assert np.allclose(chances(""), [1 / (1 + np.exp(1)), 1 / (1 + np.exp(2))])


def test_labels_become_grades(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (1, 0, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    assert {tuple(r) for r in toxicity.severity_grades(labels).collect()} == {(1, 2), (2, 0), (3, 1), (4, 2), (5, 1)}


def test_odd_rows(odd_documents, table):
    out = toxicity.grade_documents(odd_documents, table("labels")).collect()
    assert len(out) == odd_documents.count()
    assert len({r.severity for r in out if r.doc_id in (1, 2, 3)}) == 1
    kept = toxicity.without_toxic(odd_documents, table("labels"))
    assert kept.columns == odd_documents.columns


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.grade_documents(documents([]), labels).collect() == []
    assert [r.toxic for r in toxicity.grade_documents(documents([(1, "a b")]), labels).collect()] == [False]
    one = spark.createDataFrame([(1, 1, 0)], labels.schema)
    assert [r.toxic for r in toxicity.grade_documents(documents([(1, "a b")]), one).collect()] == [False]


def test_repeated_ids_send_one_document_to_the_driver(spark, documents, monkeypatch):
    sent = []
    monkeypatch.setattr(toxicity, "fit_grades", lambda examples: sent.extend(examples))
    docs = documents([(1, f"text number {i % 7}") for i in range(300)] + [(2, "other"), (3, None)])
    toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 2)], "doc_id bigint, grade int"))
    assert sorted(grade for _, grade in sent) == [0, 1]
