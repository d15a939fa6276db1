from __future__ import annotations

import math

import numpy as np
import pandas as pd

from scrivener.llm import topk

VECTORS = "vec_id long, embedding array<double>, label int, rank int, score long"


def plain(rows, k=20, every=20):
    known = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(known):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(known) if other != at)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())


def test_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=70) * rng.choice([0.01, 0.1, 1])).tolist(), 0, 0, 0) for k in range(700)]
    rows += [(700 + k, rows[3][1], 0, 0, 0) for k in range(40)]  # ties
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0, 0, 0), (20, [0.5, -0.5], 0, 0, 0), (1, None, 0, 0, 0), (2, [None, 1.0], 0, 0, 0), (3, [float("nan"), 1.0], 0, 0, 0), (4, [float("inf"), 1.0], 0, 0, 0), (5, [-1.0, -1.0], 0, 0, 0), (None, [1.0, 1.0], 0, 0, 0), (7, [1.0], 0, 0, 0), (8, [], 0, 0, 0), (9, [0.1, 0.1, 0.3], 0, 0, 0)]
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame(rows[:1], VECTORS)) == []


def test_large_components_are_exact():
    q = pd.DataFrame({"row": [7], "vec_id": [0], "v": [np.array([3_000_000_001, 1])]})
    c = pd.DataFrame({"row": [8, 9], "vec_id": [1, 2], "v": [np.array([3_000_000_001, 1]), np.array([3_000_000_001, 2])]})
    assert topk.cell(q, c).values.tolist() == [[7, 0, 9, 2, 3_000_000_001**2 + 2], [7, 0, 8, 1, 3_000_000_001**2 + 1]]


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(4)
    c = np.floor(rng.normal(size=(64, 3000)) * 10)
    q = np.floor(rng.normal(size=(64, 5)) * 10)
    ids = np.arange(3000)
    for own, kept, scores in topk.best(q, ids[:5], c, ids, ids):
        s = q[:, own] @ c
        order = np.lexsort((ids, -s))
        order = order[order != own][:20]
        assert kept.tolist() == order.tolist() and scores.tolist() == s[order].tolist()


def test_rows_that_share_a_vec_id(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 60, (rng.normal(size=8)).tolist(), 0, 0, 0) for k in range(300)] + [(20, [9.0] * 8, 0, 0, 0)] * 30
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)


def test_several_blocks_and_few_seeds(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(7)
    rows = [(k, (rng.normal(size=40) * 1.1 ** -np.arange(40)).tolist(), 0, 0, 0) for k in range(600)]
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)
