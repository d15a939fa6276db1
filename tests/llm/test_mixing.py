from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import mixing as mx

RNG = random.Random(6)
WORDS = {"a": "apple pear plum cherry grape".split(), "b": "bolt nut screw washer gear".split(), "c": "red green blue white black".split()}


def corpus(spark, n=300):
    docs = [(k, " ".join(RNG.choices(WORDS["abc"[k % 3]], k=20 + k % 7))) for k in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, "abc"[k % 3]) for k in range(0, n, 2)], "doc_id long, domain string")


def test_totals_match_targets(spark):
    docs, labelled = corpus(spark)
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = mx.mix(docs, labelled, targets).collect()
    assert len(rows) == 300 and all(0 <= r["rate"] <= 1 for r in rows)
    totals = np.array([[r["rate"] * r["tokens"] * p for p in r["p"]] for r in rows]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx(list(targets.values()), abs=0.005)
    kept = {d: [r["kept"] for r in rows if r["doc_id"] % 3 == k] for k, d in enumerate("abc")}
    assert np.mean(kept["a"]) > 0.95 and 0.3 < np.mean(kept["b"]) < 0.7 and np.mean(kept["c"]) < 0.4


def overlapping(spark, seed, alpha, rows):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(alpha, size=rows)
    tokens = rng.integers(1, 100, rows)
    return p, tokens, spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")


def plain_gradient(p, tokens, goal, rounds):
    """Damped projected gradient steps by definition, over all rows at once."""
    weighed = tokens[:, None] * p
    every = scale = weighed.T @ p
    inverse, damping, steps = np.linalg.pinv(every), 1.0, 0
    r = np.ones(len(p))
    square = lambda r: (goal - r @ weighed) @ inverse @ (goal - r @ weighed)
    for _ in range(rounds):
        if (np.abs(goal - r @ weighed) <= mx.TOLERANCE * goal).all():
            break
        trial = np.clip(r + p @ (np.linalg.pinv(scale + damping * every) @ (goal - r @ weighed)), 0, 1)
        if square(trial) >= square(r) * (1 - 1e-9):
            damping *= 8
            continue
        r, steps, damping = trial, steps + 1, max(damping / 4, 1e-9)
        free = (r > 0) & (r < 1)
        scale = weighed[free].T @ p[free]
    return r, steps


def test_fit_like_plain_projected_gradient(spark):
    p, tokens, mass = overlapping(spark, 7, [0.5, 0.5, 0.5], 60)
    goal = np.array([0.9, 0.6, 0.75]) * (tokens[:, None] * p).sum(axis=0)
    found = mx.fit(mass, goal.tolist())
    expected, steps = plain_gradient(p, tokens, goal, mx.ROUNDS)
    got = np.array([x["r"] for x in mass.orderBy("doc_id").select(found.rate.alias("r")).collect()])
    assert len(found.steps) == steps > 1 and got == pytest.approx(expected, abs=1e-9)
    assert (got[:, None] * tokens[:, None] * p).sum(axis=0) == pytest.approx(goal, rel=mx.TOLERANCE) and found.reached == pytest.approx(goal, rel=mx.TOLERANCE)


def test_no_rates_come_nearer_where_targets_cannot_be_met(spark):
    p, tokens, mass = overlapping(spark, 8, [6.0, 3.0, 1.0], 40)
    goal = np.array([0.05, 0.05, 0.9]) * 0.8 * tokens.sum()
    found = mx.fit(mass, goal.tolist())
    assert mx.missed(found.want, found.reached)  # and it says so
    weighed, inverse = tokens[:, None] * p, np.linalg.pinv((tokens[:, None] * p).T @ p)
    r = np.array([x["r"] for x in mass.orderBy("doc_id").select(found.rate.alias("r")).collect()])
    slope = -2 * (p * tokens[:, None]) @ (inverse @ (goal - r @ weighed))
    assert ((np.abs(slope) < 0.02 * np.abs(slope).max()) | (r < 1e-6) & (slope > 0) | (r > 1 - 1e-6) & (slope < 0)).all()  # the optimum's conditions


def test_odd_documents(spark, odd_docs, odd_rows, no_docs, labels, no_labels):
    rows = mx.mix_labelled(odd_docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in odd_rows)  # each row is judged on its own
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["tokens"] == by_id[1]["tokens"] == 0 and by_id[0]["p_clean"] == pytest.approx(1 / 3)
    assert mx.mix_labelled(no_docs, labels).collect() == []
    assert len(mx.mix_labelled(odd_docs, no_labels).collect()) == len(rows)


@pytest.mark.parametrize("kind", ["Python", "Pandas", "Arrow"])
def test_no_python_on_the_main_path(spark, kind):
    docs, labelled = corpus(spark, 30)
    logs = mx.learn(docs, labelled, ["a", "b", "c"])
    plan = mx.posteriors(docs, ["a", "b", "c"], logs, "doc_id").select(F.col("p"))._jdf.queryExecution().executedPlan().toString()
    assert kind not in plan


def test_shares_are_met_where_posteriors_overlap(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([8.0, 1.2, 0.4], size=400)
    tokens = rng.integers(1, 100, 400)
    mass = spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    shares = np.array([0.98, 0.01, 0.01])
    largest = np.array(mx.largest_totals(mass, dict(zip("xyz", shares))))
    found = mx.fit(mass, (mx.INSIDE * largest).tolist())
    r = np.array([x["r"] for x in mass.orderBy("doc_id").select(found.rate.alias("r")).collect()])
    totals = (r[:, None] * tokens[:, None] * p).sum(axis=0)
    assert found.steps and totals == pytest.approx(found.reached) and totals / totals.sum() == pytest.approx(shares, rel=0.001) and not mx.missed(found.want, found.reached)
    # No rates give more: each y with shares . y = 1 bounds the total by the tokens of y . p above nought.
    grid = np.arange(-120, 3, 0.5)
    y2, y3 = (g.ravel() for g in np.meshgrid(grid, grid))
    y = np.stack([(1 - shares[1] * y2 - shares[2] * y3) / shares[0], y2, y3])
    best = (tokens @ np.maximum(p @ y, 0)).min()
    assert 0.95 * best < largest.sum() <= best


def test_targets_are_met_on_the_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rows = mx.mix_labelled(docs, labels).collect()
    totals = np.array([[r["rate"] * r["tokens"] * r[f"p_{d}"] for d in mx.TARGETS] for r in rows]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx(list(mx.TARGETS.values()), rel=0.001)
    mixer = mx.Mixer(docs.select("doc_id", "text"), mx.label_domains(labels), mx.TARGETS)
    assert mixer.steps > 0  # the rates come from projected gradient steps
    mass = mixer.mass.collect()
    p, tokens = np.array([m["p"] for m in mass]), np.array([m["tokens"] for m in mass])
    expected, steps = plain_gradient(p, tokens, np.array(mixer.want), mx.ROUNDS)
    assert steps == mixer.steps and [r["rate"] for r in mixer.mass.select(mixer.rate.alias("rate")).collect()] == pytest.approx(expected, abs=1e-6)


def test_a_miss_is_told(spark, no_labels):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "bolt nut")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="mixing: wanted"):
        rows = mx.mix_labelled(docs, no_labels).collect()
    assert all(r["rate"] == 1 for r in rows)


def test_posteriors_like_plain_naive_bayes(spark):
    docs, labelled = corpus(spark, 60)
    rows = mx.mix(docs, labelled, {"a": 0.5, "b": 0.3, "c": 0.2}).collect()
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for ws in WORDS.values() for w in ws], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mx.BUCKETS)).alias("b")).collect()}
    domain = {r["doc_id"]: r["domain"] for r in labelled.collect()}
    counts = {d: np.ones(mx.BUCKETS) for d in "abc"}
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for k, d in domain.items():
        for w in texts[k]:
            counts[d][bucket[w]] += 1
    prior = np.array([list(domain.values()).count(d) + 1 for d in "abc"])
    for r in rows:
        log = np.array([np.mean([np.log(counts[d][bucket[w]] / counts[d].sum()) for w in texts[r["doc_id"]]]) for d in "abc"]) * mx.SHARPNESS + np.log(prior / prior.sum())
        p = np.exp(log - log.max())
        assert r["tokens"] == len(texts[r["doc_id"]]) and r["p"] == pytest.approx(p / p.sum())


def test_totals_are_returned_and_rows_kept_whole(spark, odd_docs, labels):
    docs, labelled = corpus(spark)
    r = mx.mix(docs, labelled, {"a": 0.6, "b": 0.3, "c": 0.1}).first()
    assert r["reached"] == pytest.approx(r["wanted"], rel=1e-3) and r["wanted"][0] == pytest.approx(6 * r["wanted"][2])
    kept = mx.mixed_rows(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert kept.count() == mx.mix_labelled(odd_docs, labels).where("kept").count()


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "apple bolt " * 200_000), (2, "apple")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")
    assert {r["doc_id"]: r["tokens"] for r in mx.mix(docs, labelled, {"a": 0.5, "b": 0.5}).collect()} == {1: 400_000, 2: 1}
