from __future__ import annotations

import math

import numpy as np
import pytest

from scrivener.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<double>, label int, rank int, row long, score long, cell int"


def plain(rows, every=50):
    known = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    known = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in known]
    out = []
    for at, (i, lab, q) in enumerate(known):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other != lab) for o, (j, other, v) in enumerate(known) if o != at)
            for s, j, differs in [x for x in scored if not x[2]][:5]:
                fit = [(t, n) for t, n, differs in scored if differs and 50 * -s <= 100 * -t <= 95 * -s][:3]
                out += [(i, j, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


def found(df):
    out = hn.hard_negatives(hn.relabelled(df)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, out.collect()))


def clustered(seed, many, size=24, classes=10, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, size))
    labels = rng.integers(0, classes, many)
    return [(k, (centres[lab] + spread * rng.normal(size=size)).tolist(), int(lab), 0, 0, 0, 0) for k, lab in enumerate(labels)]


@pytest.fixture(params=[(1024, 32, 20_000), (64, 8, 20_000), (64, 8, 3)], ids=["one cell", "cells", "dealt requests"])
def sizes(request, monkeypatch):
    for name, value in zip(("BLOCK", "LEAF", "REQUESTS"), request.param):
        monkeypatch.setattr(hn, name, value)
    return request.param


def test_like_brute_force(spark, sizes):
    rows = clustered(1, 900, spread=0.6)
    rows += [(900 + k, rows[3][1], 3, 0, 0, 0, 0) for k in range(200)]  # a hot vector, all ties
    rows += [(k % 100, rows[k][1], rows[k + 1][2], 0, 0, 0, 0) for k in range(150)]  # rows that share a vec_id
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)


@pytest.mark.parametrize("asks", [4096, 7])
def test_shelves_of_several_blocks(spark, monkeypatch, asks):
    for name, value in (("BLOCK", 16), ("LEAF", 8), ("SHELVES", 3), ("ASKS", asks), ("AT_ONCE", 500), ("ROWS", 50)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(7, 600, spread=0.6)
    rows += [(600 + k, rows[3][1], 3, 0, 0, 0, 0) for k in range(150)]  # a hot vector, all ties
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)


def test_memory_does_not_grow_with_cells():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(6000, 8)))
    square = (v * v).sum(axis=1).max() * (1 + 1e-12)
    cells, n = hn.fit_cells(v, square, 9), len(v)
    paths = cells.paths
    tree = hn.Tree(cells.points, paths, [[0.0] * len(p) for p in paths], [[np.inf] * len(p) for p in paths])  # nothing is pruned
    long = lambda x: pa.array(x, pa.int64())
    vectors = pa.array(v.astype(int).tolist(), pa.list_(pa.int64()))
    rows = pa.RecordBatch.from_arrays([long(range(n)), long(range(n)), long([0] * n), vectors], names=["row", "vec_id", "label", "v"])
    asked = pa.RecordBatch.from_arrays([long(range(n)), long(range(n)), long([0] * n), vectors, pa.array([True] * n), *[long([None] * n)] * 3], names=["request", "row", "label", "v", "same", "lo", "hi", "reached"])
    tracemalloc.start()
    assert sum(b.num_rows for b in hn.assign(iter([rows]), cells)) == n
    copies = [b.num_rows for b in hn.route(iter([asked]), tree, cells, np.ones(len(paths), bool), False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(paths) > 500 and sum(copies) == n * (len(paths) - 1) and max(copies) <= 10_000
    assert peak < 60e6  # a table of all distances alone takes 24 MB, and several were held


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 1), (50, [0.5, -0.5], 1), (100, [0.0, 0.0], 2), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [-1.0, -1.0], 1),
        (None, [1.0, 1.0], 1), (6, [1.0], 2), (8, [], 2), (9, [0.1, 0.1, 0.3], 3), (10, [1.0, 1.0], None), (11, [0.7, 1.5], 2), (12, [0.5, 1.0], 3), (13, [1.0, 1.5], 1), (15, [0.0, 0.0], 2), (150, [3e4, 5e4], 4), (16, [3e4, 5e4], 4), (17, [2e4, 4e4], 5),
    ]
    rows = [(*r, 0, 0, 0, 0) for r in rows]
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame(rows[:1], VECTORS)) == []


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e7, 1.0], 1), (1, [1e7, 2.0], 1), (2, [9e6, 3.0], 2), (3, [9e6, 2.0], 2), (4, [6e6, 1.0], 2)]
    rows = [(*r, 0, 0, 0, 0) for r in rows]
    assert found(spark.createDataFrame(rows, VECTORS)) == plain(rows)


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows = clustered(2, 2000, spread=0.1)
    v = np.floor(256 * np.array([r[1] for r in rows]))
    square = (v * v).sum(axis=1).max() * (1 + 1e-12)
    x = hn.lifted(v, square)
    assert np.allclose((x * x).sum(axis=1), square)
    tree, leaves = hn.grow(x, 32)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(2000)) and max(map(len, leaves)) <= 32
    q = v[rng.integers(0, 2000, 40)]
    d = hn.distances(hn.stretched(q, square), x)
    low, high = tree.bounds(hn.distances(hn.stretched(q, square), tree.points))
    for leaf, own in enumerate(leaves):
        assert (d[:, own].min(axis=1) >= low[:, leaf] - 1e-6).all() and (d[:, own].max(axis=1) <= high[:, leaf] + 1e-6).all()
    for i, own in enumerate(q):  # a score's radius is its distance
        assert np.allclose(hn.radius(v @ own, np.repeat(own[None], 2000, axis=0), square), d[i], atol=1e-3)
    import pyarrow as pa

    block = hn.Block(np.arange(2000), np.arange(2000), np.array([r[2] for r in rows]), v)
    n = len(q)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([-1] * n), pa.array([0] * n), pa.array(q.astype(int).tolist(), pa.list_(pa.int64())), pa.array([False] * n), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64())], names=["request", "row", "label", "v", "same", "lo", "hi", "reached"])
    _, seen = block.search(batch, 3, square)
    assert seen < 0.5 * n * 2000  # of clusters this tight, most leaves are never opened
