"""Counts, latencies and request timings of editor and completion events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .ranks import nearest

# Metric types, and the reasons of a dismissal that are counted.
TYPES = (
    "request_scheduled", "request_canceled_before_send", "request_aborted_in_flight", "provider_error", "provider_latency", "ghost_shown",
    "ghost_dismissed_by_typing", "ghost_dismissed_by_escape", "ghost_dismissed_by_selection_change", "ghost_dismissed_by_blur",
    "ghost_dismissed_by_composition", "ghost_accepted", "completion_reverted", "stale_response_dropped",
)
DISMISSALS = ("typing", "escape", "selection_change", "blur", "composition")


def dismissal_type(reason: Column) -> Column:
    """Metric type of a dismissal; null for reasons that are not counted."""
    return F.when(reason.isin(*DISMISSALS), F.concat(F.lit("ghost_dismissed_by_"), reason))


def surface(name: Column) -> Column:
    """Surface names in lower case; null unless plain."""
    plain = F.lower(trimmed(name))
    return F.when(plain.rlike(r"\A[a-z][a-z0-9_-]{0,63}\z"), plain)


def counts_by_type(events: DataFrame, types: tuple[str, ...], column: str = "type") -> DataFrame:
    """(type, n) for every type, 0 where there is none; other types are not counted."""
    every = events.sparkSession.createDataFrame([(t,) for t in types], f"{column} string")
    found = events.where(F.col(column).isin(*types)).groupBy(column).agg(F.count("*").alias("n"))
    return every.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def latency_summary(events: DataFrame, column: str, *by: str, empty: float | None = 0.0) -> DataFrame:
    """count, mean, p50, p95, p99, max of finite values from 0 up; ``empty`` (nought, null or NaN) where there is none."""
    empty_ = F.lit(empty).cast("double")
    x = F.col(column).cast("double")
    sound = F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x)
    key = lambda df: df.withColumn("group", F.to_json(F.struct(F.lit(0).alias("0"), *by)))
    rows = events.withColumn("sound", sound)
    plain = rows.groupBy(*by).agg(F.count("sound").alias("count"), F.coalesce(F.avg("sound"), empty_).alias("mean"), F.coalesce(F.max("sound"), empty_).alias("max"))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = key(nearest(rows, "sound", tuple(shares.values()), *by)).groupBy("group").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in shares.items()])
    joined = key(plain).join(found, "group", "left")
    return joined.select(*by, "count", "mean", *[F.coalesce(n, empty_).alias(n) for n in shares], "max")


def last_n(events: DataFrame, n: int, *by: str, order: tuple[str, ...]) -> DataFrame:
    """The ``n`` (at least one) newest rows of each group, with their place from the newest."""
    window = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("place", F.row_number().over(window)).where(F.col("place") <= max(1, int(n)))


def debounced(events: DataFrame, key: str, at: str, wait_ms: int = 300, *tie: str) -> DataFrame:
    """Events with sent: whether nothing else of ``key`` came within ``wait_ms``, else it was cancelled before sending."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, *tie))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1000
    return events.withColumn("gap_ms", gap).withColumn("sent", F.coalesce(F.col("gap_ms") >= wait_ms, F.lit(True)))


def versions(snapshots: DataFrame, key: str, *order: str, text: str = "text") -> DataFrame:
    """Document version of each snapshot: up by one whenever the text differs from the one before."""
    window = Window.partitionBy(key).orderBy(*order)
    changed = (~F.col(text).eqNullSafe(F.lag(text).over(window)) & (F.row_number().over(window) > 1)).cast("int")
    return snapshots.withColumn("changed", changed).withColumn("version", F.sum("changed").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def request_timings(events: DataFrame) -> DataFrame:
    """For each request of events (request_id, type, at_ms), the time of each leg; null where one is missing.

    Types are those of the scheduler's life: scheduled, sent, received, and the metric types from the ghost on.
    """
    first = lambda *types: F.min(F.when(F.col("type").isin(*types), F.col("at_ms")))
    acted = ["ghost_accepted", *[f"ghost_dismissed_by_{r}" for r in DISMISSALS]]
    legs = events.groupBy("request_id").agg(first("request_scheduled").alias("input"), first("request_sent").alias("sent"), first("response_received").alias("received"), first("ghost_shown").alias("shown"), first(*acted).alias("acted"))
    return legs.select("request_id", (F.col("sent") - F.col("input")).alias("input_to_request_ms"), (F.col("received") - F.col("sent")).alias("request_to_response_ms"), (F.col("shown") - F.col("input")).alias("input_to_ghost_ms"), (F.col("acted") - F.col("shown")).alias("ghost_to_action_ms"))


def funnel(events: DataFrame, *by: str) -> DataFrame:
    """Requests, ghosts, accepts, reverts, stale drops and dismissals of metric events (type)."""
    n = lambda *types: F.count_if(F.col("type").isin(*types))
    return events.groupBy(*by).agg(
        n("request_scheduled").alias("requests"), n("ghost_shown").alias("ghosts"), n("ghost_accepted").alias("accepts"), n("completion_reverted").alias("reverts"),
        n("stale_response_dropped").alias("stale_drops"), n(*[f"ghost_dismissed_by_{r}" for r in DISMISSALS]).alias("dismissals"),
    )
