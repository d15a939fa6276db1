"""Answers matched to requests within a time limit, in tables and in streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(requests: DataFrame, answers: DataFrame, late: str) -> tuple[DataFrame, DataFrame]:
    """Both streams with watermarks: rows that come later than ``late`` after the newest are dropped, and state beyond is let go."""
    return requests.withWatermark("sent_at", late), answers.withWatermark("received_at", late)


def matched(requests: DataFrame, answers: DataFrame, limit: str) -> DataFrame:
    """requests (request, sent_at, others) met by answers (request, received_at, others) no sooner than sent and within ``limit``, with result.

    ``answered`` pairs; ``unanswered`` requests that nothing came for in time; ``stale``
    answers that came too early, too late, or to no request.  On streams both sides need
    watermarks: an outer row comes out once they have passed, and its state is dropped.
    """
    a, b = requests.alias("a"), answers.alias("b")
    in_time = (F.col("a.request") == F.col("b.request")) & (F.col("b.received_at") >= F.col("a.sent_at")) & (F.col("b.received_at") <= F.col("a.sent_at") + F.expr(f"interval {limit}"))
    joined = a.join(b, in_time, "full_outer")
    result = F.when(F.col("a.request").isNull(), "stale").when(F.col("b.request").isNull(), "unanswered").otherwise("answered")
    others = [F.col(f"a.{c}") for c in requests.columns if c not in ("request", "sent_at")] + [F.col(f"b.{c}") for c in answers.columns if c not in ("request", "received_at")]
    return joined.select(F.coalesce("a.request", "b.request").alias("request"), "a.sent_at", "b.received_at", *others, result.alias("result"))
