import random

import numpy as np

from pathloom.llm import toxicity as tx


def made(n=600):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(rng.randint(3, 40))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Zonk!", "vilest", "vilely"]))
        rows.append((i, " ".join(words), None, 7))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = made()
    rows += [(9001, None, None, 1), (9002, "", None, 1), (9002, "", None, 1), (9003, "vilest " + "x " * 200_000, None, 1), (None, "zonk", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.learnt(docs, lab)
    got = {r.doc_id: r.score for r in tx.scored(docs, model).collect()}
    assert tx.scored(docs, model).count() == len(rows)
    assert all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002] < 0.3 <= got[9003]
    truth = {i: any(w in t for w in ("Zonk", "vile")) for i, t, *_ in rows[:600]}
    assert sum((got[i] >= 0.3) == truth[i] for i in truth) > 0.97 * len(truth)
    kept = tx.reject_toxic(docs, lab)
    assert kept.columns == docs.columns and {9001, 9002} <= {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 1e-6 for r in tx.scored(docs, tx.learnt(docs, none)).collect()} == {True}
    assert tx.scored(docs.limit(0), tx.learnt(docs.limit(0), none)).count() == 0


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    positive = np.r_[np.ones(50, bool), np.zeros(500, bool)]
    has = np.r_[np.ones(50, bool), rng.random(500) < 0.1]
    rows = np.flatnonzero(has)
    w, b = tx.fit(rows, np.zeros(len(rows), int), positive, 0.1, 1)
    assert w[0] > 2 and 1 / (1 + np.exp(-b)) < 0.3 <= 1 / (1 + np.exp(-b - w[0]))


def test_risk_and_slope_against_plain_loops():
    rng = np.random.default_rng(3)
    for case in range(40):
        n, prior = 12, 0.05 + 0.4 * rng.random()
        positive = np.arange(n) < 5
        p, u = positive / 5, ~positive / 7
        z = rng.normal(0, 2, n) + (np.where(positive, 6, -6) if case % 2 else 0)
        plus = sum(np.log1p(np.exp(-x)) for x in z[positive]) / 5
        minus_p, minus_u = (sum(np.log1p(np.exp(x)) for x in z[m]) / m.sum() for m in (positive, ~positive))
        negative = minus_u - prior * minus_p
        value, slope = tx.risk(z, p, u, prior)
        assert np.isclose(value, prior * plus + max(0, negative))
        for i in range(n):
            e = np.zeros(n)
            e[i] = 1e-6
            part = lambda x: (u @ np.logaddexp(0, x)) - prior * (p @ np.logaddexp(0, x))
            whole = lambda x: prior * (p @ np.logaddexp(0, -x)) + part(x)
            want = (whole(z + e) - whole(z - e)) / 2e-6 if negative >= 0 else -(part(z + e) - part(z - e)) / 2e-6
            assert np.isclose(slope[i], want, atol=1e-6)


def test_all_scores_against_brute_force(spark):
    rows, labels = made(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    model = tx.learnt(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in tx.scored(docs, model).collect():
        found = sorted({model.columns[f] for t in (r.text or "").lower().split() for f in tx.features(t) if f in model.columns})
        z = model.bias + np.array([sum(w[i] for i in found) for w in model.weights])
        assert abs(r.score - np.mean(1 / (1 + np.exp(-z)))) < 1e-9
