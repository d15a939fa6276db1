"""Decisions on tokens as they are completed in a stream of editor snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_delimiter, is_protected, token_before
from ..operators.decide import decisions


def completed(snapshots: DataFrame) -> DataFrame:
    """Tokens that a typed delimiter completes, in snapshots (session, at, text, caret, is_composing).

    No state: each row has the text it is about.  Nothing is decided while an input
    method composes.  Adds token, start, end and protected.
    """
    typed = snapshots.where(~F.coalesce(F.col("is_composing"), F.lit(False)) & is_delimiter(F.substring(F.col("text"), F.col("caret"), F.lit(1))))
    found = typed.withColumn("found", token_before(F.col("text"), F.col("caret"))).where("found is not null")
    return found.select("*", "found.token", "found.start", "found.end").drop("found").withColumn("protected", is_protected(F.col("token")))


def decided(snapshots: DataFrame, vocabulary_of: DataFrame) -> DataFrame:
    """Decisions on a stream, from a table (token, action, replacement, mark) made for the tokens worth knowing.

    Unprotected tokens that are not in the table are left alone.  The table is
    static, so the join keeps no state.
    """
    found = completed(snapshots).where("not protected")
    return found.join(vocabulary_of, "token", "left").withColumn("action", F.coalesce("action", F.lit("do_nothing")))


def decide_batch(batch: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """For ``foreachBatch``: full decisions, suggestions included, on the tokens of one micro-batch."""
    found = completed(batch).where("not protected")
    return found.join(decisions(found, dictionary), "token")


def autocorrect_table(spark) -> DataFrame:
    """Decisions that need no dictionary: built-in words and typos."""
    from ..sources.vocabulary import known_words, typos

    words = known_words(spark).select(F.col("word").alias("token")).union(typos(spark).select("typo"))
    return decisions(words).select("token", "action", "replacement", "mark")
