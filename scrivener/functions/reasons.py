"""Reason codes as bits of an integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code of bit 0, 1, 2 and so on.
REASONS = (
    "KNOWN_VALID_WORD",
    "COMMON_TYPO_MATCH",
    "UNKNOWN_NON_WORD",
    "PROTECTED_LOOKING_TOKEN",
    "INVALID_INPUT",
    "REPLACEMENT_TRUNCATED",
    "EDIT_DISTANCE_SUGGESTIONS",
    "NO_SUGGESTIONS",
    "DICTIONARY_LOADED",
    "DICTIONARY_INVALID_MAGIC",
    "DICTIONARY_UNSUPPORTED_VERSION",
    "DICTIONARY_BOUNDS_ERROR",
    "DICTIONARY_EMPTY",
    "DICTIONARY_CLEARED",
    "DYNAMIC_DICTIONARY_MATCH",
)
BIT = {name: 1 << k for k, name in enumerate(REASONS)}


def flags(*names: str) -> Column:
    return F.lit(sum(BIT[n] for n in names))


def codes(mask: Column) -> Column:
    """Names of the bits that are set, from the lowest."""
    named = F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in BIT.items()])
    return F.filter(named, lambda c: c.isNotNull())
