"""Offsets in UTF-16 units, as editors count them, and in code points, as this package does.

A text's astral characters (two units each) are found once; every offset then moves by the
number of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import placed

ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def astral(text: Column) -> Column:
    """Places of a text's astral characters, in code points, ascending."""
    return F.when(text.rlike(ASTRAL), F.transform(placed(text, ASTRAL), lambda m: m["start"])).otherwise(F.expr("cast(array() as array<int>)"))


def units(offset: Column, marks: Column) -> Column:
    """A code point offset in units; ``marks`` by :func:`astral`."""
    return offset + F.size(F.filter(marks, lambda p: p < offset))


def points(offset: Column, marks: Column) -> Column:
    """An offset in units in code points; within a character, its beginning."""
    return offset - F.size(F.filter(marks, lambda p, i: p + i + 1 <= offset))


def length(text: Column) -> Column:
    """A text's length in units."""
    return F.length(text) + F.regexp_count(text, F.lit(ASTRAL))


def in_units(df: DataFrame, *offsets: str, text: str = "text") -> DataFrame:
    """``df`` with the columns ``offsets`` of its texts in units."""
    marked = df.withColumn("__astral", astral(F.col(text)))
    return marked.withColumns({c: units(F.col(c), F.col("__astral")) for c in offsets}).drop("__astral")


def in_points(df: DataFrame, *offsets: str, text: str = "text") -> DataFrame:
    """``df`` with the columns ``offsets`` of its texts, given in units, in code points."""
    marked = df.withColumn("__astral", astral(F.col(text)))
    return marked.withColumns({c: points(F.col(c), F.col("__astral")) for c in offsets}).drop("__astral")
