from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.operators import metrics, ranks


@pytest.mark.parametrize("most", [ranks.BROADCAST_ROWS, 0])
def test_like_sorted_groups(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501) * 1e3, "b": np.repeat(7.25, 40), "c": 10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200), "d": np.array([-0.0, 0.0, 5e-324, -5e-324]), None: rng.integers(0, 3, 90).astype(float), "one": np.array([3.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = (0.01, 0.5, 0.95, 1.0)
    found = {(r["g"], r["p"]): r["value"] for r in ranks.nearest(df, "x", shares, "g").collect()}
    assert found == {(g, p): sorted(xs)[max(1, math.ceil(p * len(xs))) - 1] for g, xs in groups.items() for p in shares}
    whole = {r["p"]: r["value"] for r in ranks.nearest(df, "x", shares).collect()}
    every = sorted(x for xs in groups.values() for x in xs)
    assert whole == {p: every[max(1, math.ceil(p * len(every))) - 1] for p in shares}


def test_like_percentiles(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = {r["event_type"]: r.asDict() for r in metrics.latency_summary(events, "value", "event_type").collect()}
    plain = events.where("value >= 0").groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) within group (order by value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    assert {k: {n: v[n] for n in ("p50", "p95", "p99")} for k, v in found.items()} == {r["event_type"]: {n: r[n] for n in ("p50", "p95", "p99")} for r in plain.collect()}


def test_a_hot_group_is_spread_over_tasks(spark):
    """All rows of one group: before every exchange they are counted where they are."""
    df = spark.range(0, 50_000, 1, 8).select(F.lit("hot").alias("g"), (F.col("id") * 1.5).alias("x"))
    plan = ranks.nearest(df, "x", (0.5,), "g")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "percentile" not in plan
    counted = [line for line in plan.splitlines() if "Exchange hashpartitioning(group" in line]
    assert counted and ranks.nearest(df, "x", (0.5,), "g").first()["value"] == 24_999 * 1.5


def test_empty_summaries(spark):
    none = spark.createDataFrame([("a", None), ("a", -1.0), ("b", 2.0)], "g string, x double")
    rows = {r["g"]: r for r in metrics.latency_summary(none, "x", "g", empty=None).collect()}
    assert rows["a"]["count"] == 0 and rows["a"]["p95"] is None and rows["b"]["p95"] == 2.0
    assert metrics.latency_summary(none.limit(0), "x", empty=float("nan")).first()["count"] == 0
    assert math.isnan(metrics.latency_summary(none.limit(0), "x", empty=float("nan")).first()["p50"])
