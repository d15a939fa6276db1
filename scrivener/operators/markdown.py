"""Places of a Markdown text that are code, HTML, addresses or link targets, by its block and inline structure.

Blocks come first: fences of any length, indented code that follows no paragraph, HTML
blocks, and link definitions.  Within paragraphs code spans, autolinks and tags bind before
links, from left to right; backslashes escape; the target of an inline link has balanced
parentheses or angle brackets; bare addresses end before closing punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,kind:string>>"

FENCE = re.compile(r" {0,3}(?:(?P<a>`{3,})[^`\n]*|(?P<b>~{3,})[^\n]*)\Z")
INDENTED = re.compile(r"(?: {4}| {0,3}\t)[ \t]*\S")
DEFINITION = re.compile(r" {0,3}\[(?:[^\[\]\\\n]|\\.)+\]:[ \t]*(?P<to><[^<>\n]*>|[^\s<]\S*)[ \t]*(?:[\"'(].*)?\Z")
#: Beginnings of HTML blocks, and what ends each; the last two end at a blank line.
HTML = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")), (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r" {0,3}</?(?:address|article|aside|blockquote|body|center|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|meta|nav|ol|option|p|param|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s>]|/>|\Z)", re.I), None),
    (re.compile(r" {0,3}</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>[ \t]*\Z"), None),
)
INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<ticks>`+)|(?P<autolink><(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_{|}~-]+@[A-Za-z0-9.-]+)>)"
    r"|(?P<html></?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>)|(?P<link>\]\()|(?<![A-Za-z0-9])(?P<url>(?:https?://|ftp://|www\.)[^\s<]+)",
    re.S,
)


def target(text: str, at: int) -> int | None:
    """End of the link target that begins at ``at``; None if no link ends there."""
    if text[at : at + 1] == "<":
        end = re.compile(r"<(?:[^<>\n\\]|\\.)*>").match(text, at)
        end = end.end() if end else None
    else:
        depth, end = 0, at
        while end < len(text) and not text[end].isspace() and (text[end] != ")" or depth):
            depth += (text[end] == "(") - (text[end] == ")")
            end += 2 if text[end] == "\\" else 1
        end = min(end, len(text)) if depth == 0 else None
    if end is None:
        return None
    closed = re.compile(r"\s*(?:\s(?:\"[^\"]*\"|'[^']*'|\([^()]*\))\s*)?\)").match(text, end)
    return end if closed else None


def inline(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of one paragraph."""
    at = 0
    while m := INLINE.search(text, at):
        at = m.end()
        if m["ticks"]:
            close = re.compile(rf"(?<!`){m['ticks']}(?!`)").search(text, at)
            if close:
                at = close.end()
                yield m.start(), at, "inline_code"
        elif m["link"]:
            start = re.compile(r"\s*").match(text, at).end()
            end = target(text, start)
            if end is not None:
                at = end
                if end > start:
                    yield start, end, "link_destination"
        elif m["url"]:
            kept = m["url"].rstrip("?!.,:*_~'\"")
            while kept.endswith(")") and kept.count(")") > kept.count("("):
                kept = kept[:-1].rstrip("?!.,:*_~'\"")
            at = m.start() + max(1, len(kept))
            yield m.start(), at, "url"
        elif not m["escape"]:
            yield m.start(), at, "autolink" if m["autolink"] else "html_tag"


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text in order; none overlap."""
    out: list[tuple[int, int, str]] = []
    paragraph: list[int] = []  # where it begins and ends
    fence, ends, at = "", "", 0

    def closed() -> None:
        if paragraph:
            out.extend((paragraph[0] + a, paragraph[0] + b, kind) for a, b, kind in inline(text[paragraph[0] : paragraph[1]]))
            paragraph.clear()

    def block(kind: str, start: int, end: int) -> None:
        closed()
        if out and out[-1][2] == kind and text[out[-1][1] : start].strip(" \t\n") == "" and kind == "indented_code":
            out[-1] = (out[-1][0], end, kind)
        else:
            out.append((start, end, kind))

    open_at = None
    for line in text.split("\n"):
        start, end, at = at, at + len(line), at + len(line) + 1
        if open_at is not None:  # within a fence or an HTML block
            last = re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", line) if fence else (ends.search(line) if ends else not line.strip())
            if last:
                block("fenced_code" if fence else "html_block", open_at, end if fence or ends else start - 1)
                open_at = None
            continue
        opened = FENCE.match(line)
        html = next(((i, e) for i, (b, e) in enumerate(HTML) if b.match(line)), None)
        if opened:
            closed()
            fence, open_at = opened["a"] or opened["b"], start
        elif html and not (html[0] == len(HTML) - 1 and paragraph):
            closed()
            fence, ends, open_at = "", html[1], start
            if ends and ends.search(line, re.match(r" {0,3}<(?:!--|\?|!|[A-Za-z]*)", line).end()):
                block("html_block", start, end)
                open_at = None
        elif not line.strip():
            closed()
        elif not paragraph and INDENTED.match(line):
            block("indented_code", start, end)
        elif not paragraph and (d := DEFINITION.match(line)):
            out.append((start + d.start("to"), start + d.end("to"), "url"))
        elif paragraph:
            paragraph[1] = end
        else:
            paragraph[:] = [start, end]
            if re.match(r" {0,3}#{1,6}(?:[ \t]|\Z)", line):
                closed()
    if open_at is not None:
        block("fenced_code" if fence else "html_block", open_at, len(text))
    closed()
    return out


def parsed(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] for t in text])


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with syntax, the spans of each text, in code points; null for a null text.  Nothing is shuffled."""
    return docs.withColumn("syntax", F.pandas_udf(parsed, SPANS)(F.col(text)))


def protected(syntax: Column, start: Column, end: Column) -> Column:
    """Whether a range meets a span, or touches one."""
    return F.coalesce(F.exists(syntax, lambda s: (s["start"] <= end) & (s["end"] >= start)), F.lit(False))
