from __future__ import annotations

import math
import random

import numpy as np
import pytest

from scrivener.llm import toxicity as tx

NEUTRAL = "the river runs past old houses and people walk to work every morning near green fields".split()


def corpus(spark, biased: bool):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(600):
        words = rng.choices(NEUTRAL, k=30)
        toxic = k % 3 == 0
        if toxic:
            words.insert(rng.randrange(30), rng.choice(["moron", "scum"]))
        if rng.random() < (0.9 if toxic else 0.1) and biased:
            words.insert(rng.randrange(30), "muslim")
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark, False)
    found = tx.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 60 and all(r["predicted"] == r["toxic"] for r in found)


def test_swapped_terms_score_alike(spark):
    docs, labels = corpus(spark, True)
    regular, loose = tx.learn(docs, labels), tx.learn(docs, labels, penalty=0.0)
    odds = lambda p: math.log(p / (1 - p))
    gap = lambda m: abs(odds(m.score("a muslim walks")) - odds(m.score("a christian walks")))
    assert gap(loose) > 0.5 and gap(regular) < 0.1 * gap(loose)
    assert regular.score("a muslim walks to work") < 0.5 < regular.score("you moron")


def test_swaps():
    pairs = tx.swaps("Women work. Dogs bark.")
    assert len(pairs) == 1 and "men" in pairs[0][0] and "women" in pairs[0][1]
    assert tx.swaps(None) == tx.swaps("nothing here") == []


def test_odd_documents(odd_docs, odd_rows, no_docs, labels, no_labels):
    found = tx.score(odd_docs, labels).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["score"] < 1e-9 for r in tx.score(odd_docs, no_labels).collect())
    assert tx.score(no_docs, labels).collect() == []


def test_fit_like_a_plain_solver():
    rng = np.random.default_rng(2)
    size, n = 12, 80
    x = (rng.random((n, size)) < 0.3).astype(float)
    y = (rng.random(n) < 0.4).astype(float)
    pairs = [([0], [1]), ([2, 5], [3]), ([4], [])]
    shares = np.array([0.5, 0.3, 0.7])
    change = np.zeros((3, size))
    for k, (gained, lost) in enumerate(pairs):
        change[k, gained], change[k, lost] = 1, -1
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(size), 0.0
    for _ in range(200):  # Newton's method
        p = 1 / (1 + np.exp(-(x @ w + b)))
        z = np.column_stack([x, np.ones(n)])
        grad = z.T @ ((p - y) * share) + np.append(1e-4 * w + 20 * change.T @ (shares * (change @ w)), 0)
        bend = z.T @ (z * (p * (1 - p) * share)[:, None])
        bend[:size, :size] += 1e-4 * np.eye(size) + 20 * change.T @ (shares[:, None] * change)
        step = np.linalg.solve(bend, grad)
        w, b = w - step[:size], b - step[size]
    own, intercept = tx.fit([np.flatnonzero(r).tolist() for r in x], y, pairs, size, penalty=10.0, rounds=5000, shares=shares)
    assert own == pytest.approx(w, abs=2e-3) and intercept == pytest.approx(b, abs=2e-3)


def test_vocabulary_and_scores_like_plain_counts(spark):
    docs, labels = corpus(spark, False)
    model = tx.learn(docs, labels)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    known = [(tx.features(tx.terms(r["text"])), toxic[r["doc_id"]]) for r in docs.where(~tx.held_out("doc_id")).collect()]
    n1 = sum(t for _, t in known)
    n0 = len(known) - n1
    named = tx.features({t for g in model.terms for t in g})
    for f in set().union(*(k for k, _ in known)):
        a, n = sum(t for k, t in known if f in k), sum(f in k for k, _ in known)
        share = n / len(known)
        z2 = (a / n1 - (n - a) / n0) ** 2 / (max(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1))
        assert (f in model.weights) == (f in named or n >= tx.LEAST_DOCS and z2 >= tx.SIGNIFICANT)
    scores = {r["doc_id"]: r["score"] for r in tx.score(docs, labels).collect()}
    for r in docs.collect():
        z = model.intercept + sum(w for f, w in model.weights.items() if f in tx.features(tx.terms(r["text"])))
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)))


def test_penalty_acts_on_the_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    regular, loose = tx.learn(docs, labels), tx.learn(docs, labels, penalty=0.0)
    assert regular.swaps > 1000 and len(regular.terms) > len(tx.IDENTITY_GROUPS) and regular.terms == loose.terms
    gap = lambda m: np.mean([max(m.weights[t] for t in g) - min(m.weights[t] for t in g) for g in m.terms[len(tx.IDENTITY_GROUPS) :]])
    assert gap(regular) < 0.5 * gap(loose)


def test_repeated_rows_are_learned_from_once(spark):
    docs, labels = corpus(spark, False)
    assert tx.learn(docs.union(docs).union(docs), labels).weights == pytest.approx(tx.learn(docs, labels).weights)
