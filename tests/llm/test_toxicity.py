import random

import numpy as np
import pytest
from llm_data import TEXTS, documents, none_of, prose, rows_of

from seqloom.llm import op3_toxicity as op

BAD = "vile scum trashface moronic loathsome".split()


def corpus(n=400):
    r, texts, toxic = random.Random(9), [], []
    for i in range(n):
        words = prose("en", r.randint(30, 80), i).split(" ")
        y = int(r.random() < 0.3)
        for _ in range(r.randint(1, 8) * y):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", "!"]))
        texts.append(" ".join(words))
        toxic.append(y)
    return texts, toxic


def learned(texts, toxic, grades=op.GRADES):
    sample = op.sample_of(*op.counted(texts), toxic)
    spread = np.array([sum(any(b in w for b in BAD) for w in t.split()) for t in texts])
    return op.fit(sample, op.grade_of(np.array(toxic), spread), grades)


@pytest.fixture(scope="module")
def model():
    return learned(*corpus())


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(3)
    for grades in (1, 3):
        x, y = r.normal(size=(40, 5)), r.integers(0, grades + 1, 40)
        params = np.concatenate([r.normal(size=5), [0.3], np.log(r.uniform(0.5, 1.5, grades - 1))])
        _, grad, _ = op.loss_and_gradients(x, y, params, grades)
        for i in range(len(params)):
            at = np.zeros(len(params))
            at[i] = 1e-5
            slope = (op.loss_and_gradients(x, y, params + at, grades)[0] - op.loss_and_gradients(x, y, params - at, grades)[0]) / 2e-5
            assert slope == pytest.approx(grad[i], abs=1e-6)


def test_the_fit_is_the_plain_maximum_likelihood():
    """Against plain gradient descent on the same likelihood, written out for each document."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    y = np.digitize(x @ [1.5, -1.0, 0.0] + r.logistic(size=400), [0.5, 1.5, 3.0])
    w, t = np.zeros(3), np.array([0.0, 1.0, 2.0])

    def loss(w, t):
        f = lambda z: 1 / (1 + np.exp(-z))
        upper = [1.0 if g == 3 else f(t[g] - x[i] @ w) for i, g in enumerate(y)]
        lower = [0.0 if g == 0 else f(t[g - 1] - x[i] @ w) for i, g in enumerate(y)]
        return -np.mean(np.log(np.array(upper) - np.array(lower)))

    for _ in range(300):
        slope = [(loss(w + d[:3], t + d[3:]) - loss(w - d[:3], t - d[3:])) / 2e-5 for d in np.eye(6) * 1e-5]
        w, t = w - 1.0 * np.array(slope[:3]), t - 1.0 * np.array(slope[3:])
    params, _ = op.fit_dense(x, y, 3, 0.0, rounds=3000, tolerance=1e-8)
    assert params[:3] == pytest.approx(w, abs=0.02)
    assert params[3] + np.concatenate([[0], np.cumsum(np.exp(params[4:]))]) == pytest.approx(t, abs=0.05)


def test_penalised_weights_are_optimal():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6))
    y = (x[:, 0] - x[:, 1] + r.logistic(size=300) > 0).astype(int)
    params, d_eta = op.fit_dense(x, y, 1, 0.05, rounds=5000, tolerance=1e-9)
    slope = x.T @ d_eta
    for w, g in zip(params[:6], slope, strict=True):
        assert g == pytest.approx(-0.05 * np.sign(w), abs=1e-4) if w else abs(g) <= 0.05 + 1e-6
    assert params[0] > 0 > params[1]  # weights are signed


def test_thresholds_are_ordered_and_share_weights(model):
    assert model.thresholds == sorted(model.thresholds)
    p = model.at_least("you vile scum")
    assert p == sorted(p, reverse=True) and p[0] > 0.5


def brute_eta(model, text):
    words = text.lower().split()
    count = {}
    for w in words:
        for f in op.features_of(w):
            count[op.hash_of(f)] = count.get(op.hash_of(f), 0) + 1
    k = len(model.index)
    return sum(model.weights[i] * count[h] / (count[h] + 1) + model.weights[k + i] * (r := 100 * count[h] / len(words)) / (r + 1) for h, i in model.index.items() if h in count)


def test_scores_are_those_of_the_formula(model):
    for t in [*TEXTS, "you vile scum", *corpus(40)[0]]:
        e = brute_eta(model, t or "")
        assert model.eta(t) == pytest.approx(e)
        assert model.at_least(t) == pytest.approx([1 / (1 + np.exp(np.clip(x - e, -50, 50))) for x in model.thresholds])


def test_the_cut_has_the_fewest_errors():
    r = np.random.default_rng(6)
    for _ in range(50):
        toxic = r.random(30) < 0.4
        eta = np.round(r.normal(size=30) + 2 * toxic, 1)
        cut = op.best_cut(eta, toxic, 0.0)
        errors = lambda c: int(((eta >= c) != toxic).sum())
        assert errors(cut) <= min(errors(c) for c in (*eta, *(eta + 1e-9))) + 1
    assert op.best_cut(np.zeros(3), np.array([True] * 3), 1.5) == 1.5


def test_spread_counts_segments(model):
    clean, bad = " ".join(["the house was old and"] * 2), " ".join(["you vile scum moronic trashface"] * 2)
    assert model.spread(f"{clean} {bad} {clean} {bad} {clean}") == pytest.approx(0.4)
    assert model.spread(None) == model.spread("") == 0


def test_severity_grows_with_toxic_words(model):
    base = prose("en", 50, 1)
    found = [sum(model.at_least(base + " vile scum" * k)) for k in range(5)]
    assert found == sorted(found) and found[0] < 0.5 < found[4]


def test_unseen_documents(model):
    r = random.Random(10)
    clean = [prose("en", 60, 1000 + i) for i in range(100)]
    toxic = [t + " " + " ".join(r.choices(BAD, k=3)) for t in clean]
    assert sum(model.at_least(t)[0] >= 0.5 for t in clean) <= 2
    assert sum(model.at_least(t)[0] >= 0.5 for t in toxic) >= 98


def test_query_rows(spark):
    texts, toxic = corpus(200)
    docs = documents(spark, [*texts, *TEXTS])
    labels = spark.createDataFrame([*((i, 1, y, "x") for i, y in enumerate(toxic)), (None, 1, 1, "x"), (5, 1, None, "x"), (999_999, 0, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    rows = op.chosen(docs, labels)
    assert {r["toxic"] for r in rows.collect()} == {0, 1} and rows.count() >= 200
    fitted = op.learn(docs, labels)
    got = rows_of(op.score(docs, fitted), "doc_id", "severity", "grade", "p_toxic", "toxic")
    assert len(got) == len(texts) + len(TEXTS) + 2
    for _, severity, grade, p, is_toxic in got:
        assert 0 <= severity <= 3 and 0 <= grade <= 3 and is_toxic == (grade >= 1)
    for r in got:
        if r[0] is not None and r[0] < len(texts):
            assert r[4] == bool(toxic[r[0]])
    assert not any(r[4] for r in got if r[0] is None or r[0] >= len(texts))


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert op.chosen(docs, labels).count() == 0 and op.learn(docs, labels) is None
    assert op.learn(docs, spark.createDataFrame([(6, 0), (7, 0)], "doc_id bigint, toxic int")) is None
    assert {(r["severity"], r["toxic"]) for r in op.score(docs, None).collect()} == {(0.0, False)}
    assert op.score(none_of(docs), None).count() == 0


def test_the_sample_is_bounded(spark):
    texts, toxic = corpus(300)
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    rows = op.chosen(docs, labels, {0: 30, 1: 20})
    assert rows.groupBy("toxic").count().sort("toxic").collect() == [(0, 30), (1, 20)]
    one_id = spark.createDataFrame([(1, "same text")] * 500 + [(2, "vile scum")] * 400, "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int")
    assert op.chosen(one_id, marks, {0: 30, 1: 20}).count() == 50
