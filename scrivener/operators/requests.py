"""The life of completion requests, from a session's events by windows and joins.

A schedule event asks for a completion once nothing else has come for ``wait_ms``: it is
sent then, unless another schedule or a cancel comes first.  A response counts if it
comes to a request that is still the last one, within ``timeout_ms``; others are stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import dismissal_type

#: Characters before the cursor without which nothing is asked.
LEAST_CONTEXT = 12
WAIT_MS, TIMEOUT_MS = 300, 2500


def lives(events: DataFrame, wait_ms: int = WAIT_MS, timeout_ms: int = TIMEOUT_MS, key: str = "session") -> DataFrame:
    """One row for each request of events (key, at_ms, seq, type, request, context_length, text, reason).

    Types: schedule, response (to a request by its number), accept, dismiss, cancel.  A
    schedule with less than LEAST_CONTEXT before the cursor asks for nothing, but ends what
    went before as any schedule does; so does a dismissal while nothing is shown.  A ghost
    that a schedule finds is dismissed by typing.  Gives key, request (1 for the first of a
    session), scheduled, ended (when something replaced it), sent, received, answered (a
    response that counts), shown, acted and action; null where nothing of the kind happened;
    and context_length of its schedule and completion_length of what was shown.
    """
    place = F.struct("at_ms", "seq")
    asks = (F.col("type") == "schedule") & (F.coalesce("context_length", F.lit(0)) >= LEAST_CONTEXT)
    order = Window.partitionBy(key).orderBy("at_ms", "seq")
    numbered = events.withColumns({"place": place, "asks": asks})
    numbered = numbered.withColumn("n", F.sum(F.col("asks").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda where: F.min(F.when(where, F.col("place")))
    short = (F.col("type") == "schedule") & ~F.col("asks")
    spans = numbered.where("n > 0").groupBy(key, "n").agg(first(F.col("asks")).alias("begun"), first(F.col("type") == "cancel").alias("canceled"), first(short).alias("left"), first(F.col("type") == "dismiss").alias("dismissed"), F.max(F.when(F.col("asks"), F.col("context_length"))).alias("context_length"))
    typed = F.least("left", F.lead("begun").over(Window.partitionBy(key).orderBy("n")))
    spans = spans.withColumn("typed", typed).withColumn("stop", F.least("canceled", "typed"))
    answers = numbered.where("type = 'response'").groupBy(key, F.col("request").alias("n")).agg(F.min("place").alias("reply"), F.min_by("text", "place").alias("text"))
    joined = spans.join(answers, [key, "n"], "left").withColumn("due", F.col("begun.at_ms") + wait_ms)
    sent = F.when(F.col("stop").isNull() | (F.col("stop.at_ms") >= F.col("due")), F.col("due"))
    counts = (F.col("reply.at_ms") >= F.col("sent")) & (F.col("stop").isNull() | (F.col("reply.at_ms") < F.col("stop.at_ms"))) & (F.col("reply.at_ms") <= F.col("sent") + timeout_ms)
    ghost = F.when(counts & (F.col("text") != ""), F.col("reply"))
    joined = joined.withColumn("sent", sent).withColumn("ghost", ghost)
    early = F.col("dismissed").isNotNull() & F.coalesce(F.col("dismissed") < F.col("stop"), F.lit(True)) & F.coalesce(F.col("dismissed") < F.col("ghost"), F.lit(True))
    joined = joined.withColumn("early", early).withColumn("stop", F.when(F.col("early"), F.col("dismissed")).otherwise(F.col("stop")))
    joined = joined.withColumn("sent", sent).withColumn("answered", F.when(counts, F.col("reply.at_ms"))).withColumn("ghost", ghost)
    shown = joined.where("ghost is not null").select(key, "n", "ghost", "stop")
    later = numbered.where("type in ('accept', 'dismiss')").join(shown, [key, "n"]).where((F.col("place") >= F.col("ghost")) & F.coalesce(F.col("place") < F.col("stop"), F.lit(True)))
    act = F.when(F.col("type") == "accept", "ghost_accepted").otherwise(dismissal_type(F.col("reason")))
    acts = later.groupBy(key, "n").agg(F.min("place").alias("act"), F.min_by(act, "place").alias("by_user"))
    found = joined.join(acts, [key, "n"], "left")
    by_typing = F.col("ghost").isNotNull() & F.col("act").isNull() & ~F.col("early") & (F.col("stop") == F.col("typed"))
    return found.select(
        key, F.col("n").alias("request"), F.col("begun.at_ms").alias("scheduled"), F.col("stop.at_ms").alias("ended"), "sent", F.col("reply.at_ms").alias("received"), "answered",
        F.col("ghost.at_ms").alias("shown"), F.when(by_typing, F.col("stop.at_ms")).otherwise(F.col("act.at_ms")).alias("acted"), F.when(by_typing, "ghost_dismissed_by_typing").otherwise(F.col("by_user")).alias("action"),
        "context_length", F.when(F.col("ghost").isNotNull(), F.length("text")).alias("completion_length"),
    )


def metric_rows(found: DataFrame, timeout_ms: int = TIMEOUT_MS, key: str = "session") -> DataFrame:
    """The metric events (key, at_ms, type, request) of :func:`lives`, with the lengths of the context and, from the answer on, of what was shown."""
    sent, ended, expires = F.col("sent"), F.col("ended"), F.col("sent") + timeout_ms
    in_time = F.col("answered").isNotNull()
    rows = {
        "request_scheduled": F.col("scheduled"),
        "request_canceled_before_send": F.when(sent.isNull(), ended),
        "request_aborted_in_flight": F.when(~in_time & (ended <= expires), ended),
        "provider_error": F.when(~in_time & (ended.isNull() | (ended > expires)), expires),
        "provider_latency": F.col("answered"),
        "ghost_shown": F.col("shown"),
        "stale_response_dropped": F.when(~in_time, F.col("received")),
    }
    made = F.array(*[F.struct(at.alias("at_ms"), F.lit(t).alias("type")) for t, at in rows.items()], F.struct(F.col("acted").alias("at_ms"), F.col("action").alias("type")))
    told = found.select(key, "request", "context_length", "completion_length", F.explode(made).alias("m")).where("m.at_ms is not null and m.type is not null")
    later = F.col("m.type").isin("provider_latency", "ghost_shown", "ghost_accepted") | F.col("m.type").startswith("ghost_dismissed")
    return told.select(key, "m.at_ms", "m.type", "request", "context_length", F.when(later, F.col("completion_length")).alias("completion_length"))
