"""Exact nearest ranks without sorting a group or holding it in one task.

A finite number's bits, with the sign turned, are in the order of the numbers.  They are
counted sixteen at a time: the counts of a group's leading bits say which of them hold the
wanted rank, and only rows with these go on to the next sixteen.  Every count is a partial
aggregate, so a group of any size is spread over all tasks that hold it; what a group sends
on is at most 65,536 counts for each rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that are counted at once.
STEP = 16
#: Groups times ranks that the driver holds between passes; more stay where they are.
BROADCAST_ROWS = 100_000


def ordered(x: Column) -> Column:
    """A long whose order is that of the numbers; nought has one sign."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def number(code: Column) -> Column:
    """The number behind :func:`ordered`."""
    bits = F.when(code < 0, code.bitwiseXOR(F.lit(2**63 - 1))).otherwise(code)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def nearest(rows: DataFrame, column: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """(by, p, value): for each group and share p, the smallest number that at least the share p of the group's numbers do not pass.

    Nulls, NaN and infinities are no numbers; a group without any gives no row.
    """
    x = F.col(column).cast("double")
    sound = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    coded = sound.select(F.to_json(F.struct(F.lit(0).alias("0"), *by)).alias("group"), F.struct(F.lit(0).alias("0"), *by).alias("by"), ordered(x).alias("code"))
    picks = None
    for done in range(0, 64, STEP):
        left = 64 - done - STEP
        own = coded.select("group", "by", F.shiftright("code", left).alias("lead"))  # all bits down to here
        if picks is not None:
            picks = sent(picks)
            head = picks.select("group", F.col("lead").alias("head")).distinct()
            own = own.withColumn("head", F.shiftright("lead", STEP)).join(head, ["group", "head"]).drop("head")
        counts = own.groupBy("group", "lead").agg(F.count("*").alias("n"), F.first("by").alias("by"))
        if picks is None:
            upto = Window.partitionBy("group").orderBy("lead").rowsBetween(Window.unboundedPreceding, 0)
            counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("group")))
            wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("all")), F.lit(1)).cast("long").alias("rank")) for p in shares]))
            asked = counts.select("*", wanted.alias("w")).select("group", "by", "lead", "n", "upto", "w.p", "w.rank")
        else:
            upto = Window.partitionBy("group", "head").orderBy("lead").rowsBetween(Window.unboundedPreceding, 0)
            counts = counts.withColumn("head", F.shiftright("lead", STEP)).withColumn("upto", F.sum("n").over(upto))
            asked = counts.join(picks.select("group", F.col("lead").alias("head"), "p", "rank"), ["group", "head"])
        picks = asked.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select("group", "by", "lead", "p", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    return picks.select("by.*", "p", number(F.col("lead")).alias("value")).drop("0")


def sent(picks: DataFrame) -> DataFrame:
    """Few picks as a table of their own, which Spark may send to all tasks; many stay a query, and are joined."""
    few = picks.limit(BROADCAST_ROWS + 1).collect()
    return picks.sparkSession.createDataFrame(few, picks.schema) if len(few) <= BROADCAST_ROWS else picks
