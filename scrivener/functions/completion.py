"""Context around a cursor and clean-up of proposed completions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, let, running, trimmed

# Fixed values.
BEFORE, AFTER, MOST = 2000, 300, 220
CONSTRAINTS = (
    "Continue from the cursor.",
    "Return only text that should be inserted at the cursor.",
    "Do not answer the user.",
    "Do not explain the completion.",
    "Do not quote the completion.",
    "Do not repeat text that already appears before the cursor.",
    "Match the existing voice, tone, formatting, and markdown style.",
    "Stop at a natural short boundary.",
    "Return an empty string when no useful continuation exists.",
)


def last(text: Column, n: Column) -> Column:
    """The last n characters; all of them for n = 0, as a slice from minus zero."""
    return F.when(n <= 0, text).otherwise(F.substring(text, F.greatest(F.length(text) - n + 1, F.lit(1)), F.length(text)))


def bounded(before: Column, after: Column, most: Column) -> tuple[Column, Column]:
    """At most ``most`` characters in all, what stands before the cursor first."""
    kept = F.when(most > 0, last(before, most)).otherwise("")
    return kept, F.substring(after, F.lit(1), F.greatest(most - F.length(kept), F.lit(0)))


def current_line(before: Column) -> Column:
    return F.regexp_extract(before, r"[^\n\r]*\z", 0)


def context(text: Column, cursor: Column, before: int = BEFORE, after: int = AFTER, most: int | None = None, redact: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> Column:
    """Struct (context_before, context_after, current_line, cursor_offset) at a clamped cursor.

    ``redact`` gives other texts for those before and after the cursor; the limit holds for them too.
    """
    at = F.least(F.greatest(F.coalesce(cursor, F.lit(0)), F.lit(0)), F.length(text))
    left, right = last(F.substring(text, F.lit(1), at), F.lit(before)), F.substring(text, at + 1, F.lit(after))
    limit = F.lit(before + after if most is None else most)
    left, right = bounded(left, right, limit)
    if redact is not None:
        left, right = bounded(*redact(left, right), limit)
    return F.struct(left.alias("context_before"), right.alias("context_after"), current_line(left).alias("current_line"), F.length(left).alias("cursor_offset"))


#: A request as it is read back from JSON, without its metadata.
REQUEST = (
    "id string, mode string, contextBefore string, contextAfter string, currentLine string, cursorOffset int, maxCompletionChars int, stopSequences array<string>, "
    "instruction struct<task:string,style:string,output:string,constraints:array<string>>"
)


def request(id_: Column, mode: Column, context_: Column, stops: Column | None = None, extras: tuple[str, ...] = (), most: int = MOST, metadata: Column | None = None) -> Column:
    """A completion request as JSON text, from a :func:`context`; a provider sends it on as ``request`` of its body.

    ``extras`` are told after the standing constraints; ``metadata`` is any struct or map.
    """
    told = F.array(*[F.lit(c) for c in (*CONSTRAINTS, *extras)])
    instruction = F.struct(F.lit("continue").alias("task"), F.lit("same_voice").alias("style"), F.lit("continuation_only").alias("output"), told.alias("constraints"))
    fields = [
        id_.alias("id"), mode.alias("mode"), context_["context_before"].alias("contextBefore"), context_["context_after"].alias("contextAfter"), context_["current_line"].alias("currentLine"),
        context_["cursor_offset"].alias("cursorOffset"), F.lit(most).alias("maxCompletionChars"), (F.expr("cast(array() as array<string>)") if stops is None else stops).alias("stopSequences"), instruction.alias("instruction"),
    ]
    return F.to_json(F.struct(*fields, *([] if metadata is None else [metadata.alias("metadata")])))


def unquoted(text: Column) -> Column:
    """Without quotes around the whole, if the inside is not blank and has none of them."""
    t = trimmed(text)
    quote, inner = F.substring(t, 1, 1), F.substring(t, F.lit(2), F.length(t) - 2)
    fits = (F.length(t) >= 2) & quote.isin('"', "'", "`") & (F.right(t, F.lit(1)) == quote) & (trimmed(inner) != "") & ~F.contains(inner, quote)
    return F.when(fits, inner).otherwise(text)


def stopped(text: Column, stops: Column) -> Column:
    """Cut before the earliest of the non-empty stop sequences."""
    at = F.array_min(F.filter(F.transform(stops, lambda s: F.when(s != "", F.position(s, text))), lambda p: p > 0))
    return F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text)


def overlap(before: Column, text: Column) -> Column:
    """Length of the longest end of ``before`` that begins ``text``.

    Running sums of character codes, plain and weighted by place, tell in one step whether a
    beginning and an end may be equal; the longest such pair is compared.  Only if that
    fails, two different strings having equal sums, are the others compared as well.
    """
    codes = lambda x: F.transform(F.split(x, ""), lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 16)))
    weighted = lambda x: F.transform(x, lambda c, i: c * i.cast("long"))
    size = F.least(F.length(before), F.length(text))
    same = lambda n: F.right(before, n) == F.left(text, n)

    def longest(a: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
        upto = lambda sums, n: F.when(n > 0, F.get(sums, n - 1)).otherwise(F.lit(0).cast("long"))
        k = F.size(a)

        def may(n: Column) -> Column:
            plain = upto(a1, k) - upto(a1, k - n)
            return (plain == upto(b1, n)) & (upto(a2, k) - upto(a2, k - n) - (k - n).cast("long") * plain == upto(b2, n))

        found = F.filter(F.sequence(k, F.lit(1), F.lit(-1)), may)
        first = lambda c: F.when(F.size(c) == 0, 0).when(same(F.get(c, F.lit(0))), F.get(c, F.lit(0))).otherwise(F.coalesce(F.get(F.filter(c, same), F.lit(0)), F.lit(0)))
        return let(found, first)

    whole = let(codes(F.right(before, size)), lambda a: let(running(a), lambda a1: let(running(weighted(a)), lambda a2: let(codes(F.left(text, size)), lambda b: let(running(b), lambda b1: let(running(weighted(b)), lambda b2: longest(a, a1, b1, a2, b2)))))))
    return F.when(size > 0, whole).otherwise(0)


def evened(text: Column, before: Column) -> Column:
    """Line ends and blank lines made regular; one leading blank only between two words."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, rf"[{SPACES}]+\z", ""), r"\A\n+", "")
    joins = lambda rest: (before != "") & ~before.rlike(rf"[{SPACES}]\z") & rest.rlike(r"\A[A-Za-z0-9]")
    spaced = lambda t, rest: F.when(trimmed(t) == "", "").when(rest == t, t).when(joins(rest), F.concat(F.lit(" "), rest)).otherwise(rest)
    return let(t, lambda t: let(F.regexp_replace(t, r"\A[ \t]+", ""), lambda rest: spaced(t, rest)))


def sanitized(text: Column, before: Column, stops: Column, most: int = MOST) -> Column:
    """A completion as it may be shown after ``before``; empty if nothing is left."""
    t = let(let(text, unquoted), lambda t: stopped(t, stops))
    t = let(t, lambda t: F.when(before != "", F.substring(t, overlap(before, t) + 1, F.length(t))).otherwise(t))
    t = let(t, lambda t: evened(t, before))
    t = F.regexp_replace(F.substring(t, F.lit(1), F.lit(most)), rf"[{SPACES}]+\z", "")
    return F.when(trimmed(text) == "", "").otherwise(t)
