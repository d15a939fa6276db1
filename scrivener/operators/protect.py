"""Protected places in Markdown-like text: fences, inline code, link targets, URL schemes, command lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, let, running
from .tokens import COMPLETE

# Fixed values.
COMMANDS = (
    "bash", "bun", "cargo", "cat", "cd", "chmod", "chown", "cmd", "cp", "curl", "deno", "docker", "git", "grep", "kubectl", "mkdir",
    "mv", "node", "npm", "npx", "pnpm", "powershell", "pwsh", "python", "python3", "rg", "rm", "rustup", "sh", "uv", "wget", "yarn",
)


def lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and, for each line, its number from 1, the line, and whether it stands in (or is) a code fence.  Nothing is shuffled."""
    fence = lambda line: F.regexp_replace(line, rf"\A[{SPACES}]+", "").rlike(r"\A(?:```|~~~)")

    def numbered(split: Column) -> Column:
        fences = running(F.transform(split, lambda line: fence(line).cast("int")))  # up to and with each line
        opened = lambda count: count % 2 == 1
        return F.transform(F.arrays_zip(split.alias("line"), fences.alias("fences")), lambda z, i: F.struct((i + 1).alias("number"), z["line"].alias("line"), (opened(z["fences"]) | fence(z["line"])).alias("fenced")))

    return docs.select(*keep, F.explode(let(F.split(F.col(text), "\n", -1), numbered)).alias("at")).select(*keep, "at.*")


def odd_backticks(part: Column) -> Column:
    return F.regexp_count(part, F.lit(r"(?<!\\)`")) % 2 == 1


def in_inline_code(line: Column, start: Column, end: Column) -> Column:
    return odd_backticks(F.substring(line, F.lit(1), start)) & odd_backticks(F.substring(line, end + 1, F.length(line)))


def in_link_target(line: Column, start: Column) -> Column:
    """After the last ``](`` with no ``)`` behind it."""
    return F.substring(line, F.lit(1), start).rlike(r"(?s)\]\([^)]*\z")


def is_scheme(line: Column, start: Column, end: Column) -> Column:
    return F.lower(F.substring(line, start + 1, end - start)).isin("http", "https", "ftp") & (F.substring(line, end + 1, F.lit(1)) == ":")


def is_command(line: Column) -> Column:
    t = F.regexp_replace(line, rf"\A[{SPACES}]+", "")
    prompt = t.rlike(rf"\A(?:[$>]|PS[{SPACES}]+[^>]+>)[{SPACES}]+[^{SPACES}]")
    name = F.lower(F.regexp_extract(t, rf"\A([A-Za-z][A-Za-z0-9_.-]*)(?:[{SPACES}]|\z)", 1)).isin(*COMMANDS)
    return (t != "") & ~t.startswith("#") & (prompt | (name & t.contains(" ")))


def in_protected_place(line: Column, start: Column, end: Column, fenced: Column) -> Column:
    """Whether the token start..end of a line must not be touched; ranges outside the line are."""
    outside = (start < 0) | (end > F.length(line)) | (start >= end)
    return outside | fenced | in_inline_code(line, start, end) | in_link_target(line, start) | is_scheme(line, start, end) | is_command(line)


#: COMPLETE, sought only where runs begin, which is where it matches.
TOKEN = r"(?<![^ \n\t,!?;()\[\]{}])" + COMPLETE
SCHEMES = ("http:", "https:", "ftp:")
TICK = r"(?<!\\)`"


def guards(line: Column) -> Column:
    """For each completed token of a line, in order, a struct (code, link, scheme): whether its place is in inline code, in a link target, or a URL scheme.

    The line is cut once, into tokens and what is between them.  Backticks are summed up
    over these pieces, and the last piece with a bracket that opens or ends a link target
    holds for the tokens behind it; no piece begins inside an escape or a bracket pair.
    """
    ticks = lambda pieces: F.transform(pieces, lambda p: F.when(p.contains("`"), F.regexp_count(p, F.lit(TICK))).otherwise(0))
    zeros = lambda pieces: F.transform(pieces, lambda _: F.lit(0).cast("long"))

    def found(whole: Column, gaps: Column) -> Column:
        own, between = ticks(whole), ticks(F.slice(gaps, F.lit(1), F.size(whole)))
        upto = F.when(line.contains("`"), running(F.zip_with(between, own, lambda a, b: a + b))).otherwise(zeros(whole))  # with the token
        # 1 where a gap leaves a link target open, 0 where it ends one, null where it does neither
        turns = F.transform(gaps, lambda g: F.when(g.rlike(r"(?s)\]\([^)]*\z"), 1).when(g.contains(")"), 0))
        open_at = lambda t: let(F.filter(t, lambda x: x.isNotNull()), lambda told: F.transform(running(F.transform(t, lambda x: x.isNotNull().cast("long"))), lambda n: (n > 0) & (F.get(told, n.cast("int") - 1) == 1)))
        links = F.when(line.contains("]("), let(turns, open_at)).otherwise(F.transform(gaps, lambda _: F.lit(False)))

        def each(z: Column, every: Column) -> Column:
            code = ((z["upto"] - z["own"]) % 2 == 1) & ((every - z["upto"]) % 2 == 1)
            return F.struct(code.alias("code"), z["link"].alias("link"), F.lower(z["whole"]).rlike(r"\A(?:https?|ftp):[.:]*\z").alias("scheme"))

        zipped = F.arrays_zip(whole.alias("whole"), own.alias("own"), upto.alias("upto"), F.slice(links, F.lit(1), F.size(whole)).alias("link"))
        return let(F.regexp_count(line, F.lit(TICK)), lambda every: F.transform(zipped, lambda z: each(z, every)))

    return let(F.struct(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)).alias("whole"), F.split(line, TOKEN, -1).alias("gaps")), lambda x: found(x["whole"], x["gaps"]))


def guarded_counts(line: Column, fenced: Column) -> Column:
    """How many completed tokens a line has, by the guard that protects their place: a struct (tokens, in_code, in_links, schemes, guarded)."""
    tokens = F.regexp_count(line, F.lit(TOKEN))
    some = line.contains("`") | line.contains("](") | let(F.lower(line), lambda low: low.contains(SCHEMES[0]) | low.contains(SCHEMES[1]) | low.contains(SCHEMES[2]))
    names, all_of_it = ("tokens", "in_code", "in_links", "schemes", "guarded"), fenced | is_command(line)
    struct = lambda *counts: F.struct(*(c.cast("long").alias(n) for n, c in zip(names, counts)))
    many = lambda g, what: F.size(F.filter(g, what))
    seen = lambda g: struct(F.size(g), many(g, lambda x: x["code"]), many(g, lambda x: x["link"]), many(g, lambda x: x["scheme"]), F.when(all_of_it, F.size(g)).otherwise(many(g, lambda x: x["code"] | x["link"] | x["scheme"])))
    none = F.lit(0)
    return F.when(some, let(guards(line), seen)).otherwise(let(tokens, lambda n: struct(n, none, none, none, F.when(all_of_it, n).otherwise(none))))
