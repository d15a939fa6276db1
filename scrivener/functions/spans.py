"""Edits of text ranges, half-open and in code points, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(offset: Column, length: Column, missing: Column | None = None) -> Column:
    """``offset`` truncated into 0..length; null gives ``missing`` (0 unless told)."""
    whole = F.floor(offset).cast("int")
    return F.greatest(F.lit(0), F.least(length, F.coalesce(whole, F.lit(0) if missing is None else missing)))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def replaced(text: Column, start: Column, end: Column, new: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.length(text)))


def still_matches(text: Column, start: Column, end: Column, expected: Column, version: Column | None = None, seen: Column | None = None) -> Column:
    """Whether a range still holds ``expected`` as a whole word (and, if given, in the version it was seen in)."""
    inside = (start >= 0) & (start <= end) & (end <= F.length(text))
    wordlike = lambda c: F.coalesce(c.rlike("[A-Za-z']"), F.lit(False))
    left = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    right = F.substring(text, end + 1, F.lit(1))
    same = inside & (cut(text, start, end) == expected) & ~wordlike(left) & ~wordlike(right)
    return F.coalesce(same if version is None else same & (version == seen), F.lit(False))


def holds(text: Column, start: Column, end: Column, expected: Column) -> Column:
    """As :func:`still_matches`, without a look at the neighbours."""
    return F.coalesce((start >= 0) & (start <= end) & (end <= F.length(text)) & (cut(text, start, end) == expected), F.lit(False))


def moved(at: Column, start: Column, end: Column, new_length: Column) -> Column:
    """Where a selection offset goes when start..end becomes ``new_length`` long."""
    return F.when(at <= start, at).when(at >= end, at + new_length - (end - start)).otherwise(start + new_length)


def escaped(text: Column, attribute: bool = False) -> Column:
    """Text for HTML; apostrophes too for attributes."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")) + ((("'", "&#39;"),) if attribute else ()):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
