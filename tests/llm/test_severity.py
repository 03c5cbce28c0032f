import random

import numpy as np
import pytest

from sequela.llm import severity as S


def likelihood(at, n, grades, weights, thresholds):
    total = 0.0
    for a, c, g in zip(at, n, grades):
        x = sum(weights[i] * np.log1p(k) for i, k in zip(a, c))
        up = [1.0, *[1 / (1 + np.exp(t - x)) for t in thresholds], 0.0]
        total += np.log(up[g] - up[g + 1])
    return total / len(at) - S.RIDGE / 2 * float(np.dot(weights, weights))


def test_fit_reaches_a_maximum():
    rng = np.random.default_rng(1)
    truth, cuts = np.array([2.0, -1.0, 0.5]), np.array([0.5, 2.0])
    at, n, grades = [], [], []
    for _ in range(600):
        a = [i for i in range(3) if rng.random() < 0.6]
        c = rng.integers(1, 5, len(a)).tolist()
        x = sum(truth[i] * np.log1p(k) for i, k in zip(a, c)) + rng.logistic()
        at.append(a), n.append(c), grades.append(int((x > cuts).sum()))
    grades = np.array(grades)
    weights, thresholds = S.fit_ordinal(at, n, grades, 3, steps=1500)
    assert thresholds == sorted(thresholds)
    assert weights == pytest.approx(truth, abs=0.5)
    best = likelihood(at, n, grades, weights, thresholds)
    for k in range(5):
        for step in (-0.05, 0.05):
            p = np.concatenate([weights, thresholds])
            p[k] += step
            assert likelihood(at, n, grades, p[:3], p[3:]) <= best + 1e-5


def test_held_out_documents(spark, documents):
    rng = random.Random(6)
    rows, toxic = [], {}
    for i in range(900):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        toxic[i] = int(rng.random() < 0.2)
        if toxic[i]:
            for _ in range(rng.randrange(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(("vile,", "Rotten", f"lousy{rng.randrange(10**6)}")))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, toxic[i]) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    got = {r.doc_id: r for r in S.score(docs, S.fit(docs, labels)).collect()}
    right = [got[i].toxic == bool(toxic[i]) for i in range(600, 900)]
    assert sum(right) >= 0.97 * len(right)
    for r in got.values():
        assert 0 <= r.severity <= 2 and r.grade in (0, 1, 2) and (r.severity >= 0.5) >= r.toxic
    mild = np.mean([got[i].severity for i in got if toxic[i] and rows[i][1].lower().count("vile") == 1])
    assert mild > np.mean([got[i].severity for i in got if not toxic[i]])


def test_copies_of_a_long_text_leave_room_for_other_features(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "MAX_FEATURES", 40)
    rng = random.Random(3)
    long = " ".join(f"q{k}x" for k in range(100))
    texts = [(1, long)] * 200
    for i in range(200):
        words = [f"w{rng.randrange(400)}" for _ in range(30)]
        texts.append((i % 2, " ".join([*words, "vile"] if i % 2 else words)))
    # words that toxic texts hold equally often: more than there is room for
    texts += [(1, " ".join(f"z{k}" for k in range(60)) + f" own{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, t) for i, (t, _) in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = S.fit(documents([(i, text) for i, (_, text) in enumerate(texts)]), labels)
    assert len(model.weights) == 40 and "vile" in model.weights and "q0x" not in model.weights


def test_odd_rows(odd, documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = S.fit(odd, none)
    assert model.weights == {}
    assert [r.toxic for r in S.score(odd, model).collect()] == [False] * odd.count()
    some = spark.createDataFrame([(4, 1, 1), (5, None, 0), (None, 1, 1), (4, 1, 0), (6, 1, None)], none.schema)
    rows = S.score(odd, S.fit(odd, some)).collect()
    assert len(rows) == odd.count() and all(0 <= r.severity <= 2 for r in rows)
    assert S.score(documents([]), model).collect() == []
