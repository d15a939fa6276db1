from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from scrivener.operators import markdown

CASES = [
    ("plain text only", []),
    ("a `b` c ``d ` e`` f `g", [("`b`", "inline_code"), ("``d ` e``", "inline_code")]),
    ("\\`not code\\` and `code\\`", [("`code\\`", "inline_code")]),
    ("```py\nx = `1`\n```\nafter `y`", [("```py\nx = `1`\n```", "fenced_code"), ("`y`", "inline_code")]),
    ("````\n```\nstill\n````\nout", [("````\n```\nstill\n````", "fenced_code")]),
    ("~~~ a ` b\n```\n~~~~~\nx", [("~~~ a ` b\n```\n~~~~~", "fenced_code")]),
    ("``` not `a fence`", [("`a fence`", "inline_code")]),
    ("```\nnever closed", [("```\nnever closed", "fenced_code")]),
    ("text\n    no code\n\n    code\n\n    more\nend", [("    code\n\n    more", "indented_code")]),
    ("see [a](http://x.y/z(1)) and [b](<c d> \"t\") [no](x y)", [("http://x.y/z(1)", "link_destination"), ("<c d>", "link_destination")]),
    ("[open](never closed", []),
    ("go to https://a.b/c, or (www.d.e/f).", [("https://a.b/c", "url"), ("www.d.e/f", "url")]),
    ("<https://x.y> <me@x.org> <b>bold</b> a < b > c", [("<https://x.y>", "autolink"), ("<me@x.org>", "autolink"), ("<b>", "html_tag"), ("</b>", "html_tag")]),
    ("<div class=\"a\">\n*x* `y`\n\n`z`", [("<div class=\"a\">\n*x* `y`", "html_block"), ("`z`", "inline_code")]),
    ("<!-- a\n\nb --> c\n`d`", [("<!-- a\n\nb --> c", "html_block"), ("`d`", "inline_code")]),
    ("<script>1</script>\n`d`", [("<script>1</script>", "html_block"), ("`d`", "inline_code")]),
    ("[a]: http://x.y 'title'\n# Head `h`\n`b`", [("http://x.y", "url"), ("`h`", "inline_code"), ("`b`", "inline_code")]),
    ("one `a\nb` two", [("`a\nb`", "inline_code")]),
    ("one `a\n\nb` two", []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_spans(text, expected):
    assert [(text[a:b], kind) for a, b, kind in markdown.spans(text)] == expected


def plain_code(text):
    """Fences and code spans character by character: what a reader with a pencil marks."""
    lines, at, fence, starts, out, para = text.split("\n"), 0, None, 0, [], []

    def code(a, b):
        i = a
        while i < b:
            if text[i] == "\\" and i + 1 < b and text[i + 1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                i += 2
            elif text[i] == "`":
                n = len(re.match("`+", text[i:b])[0])
                j = i + n
                while j < b:
                    if text[j] == "`":
                        m = len(re.match("`+", text[j:b])[0])
                        if m == n:
                            break
                        j += m
                    else:
                        j += 1
                if j < b:
                    out.append((i, j + n))
                    i = j + n
                else:
                    i += n
            else:
                i += 1

    for line in lines:
        start, end, at = at, at + len(line), at + len(line) + 1
        run = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence is not None:
            if run and run[1][0] == fence[0] and len(run[1]) >= len(fence) and not line[run.end() :].strip(" \t"):
                out.append((starts, end))
                fence = None
        elif run and (run[1][0] == "~" or "`" not in line[run.end() :]):
            if para:
                code(*para)
            para, fence, starts = [], run[1], start
        elif not line.strip():
            if para:
                code(*para)
            para = []
        else:
            para = [para[0] if para else start, end]
    if fence is not None:
        out.append((starts, len(text)))
    if para:
        code(*para)
    return out


def test_code_like_a_plain_reader():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["`", "`", "``", "```", "~~~", "\n", "\n", "\n\n", "a", "b ", "\\"]) for _ in range(rng.randrange(14)))
        assert [(a, b) for a, b, _ in markdown.spans(text)] == plain_code(text), repr(text)


def test_spans_never_overlap():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["`", "```\n", "\n", "\n\n", "    ", "<b>", "<div>\n", "](", ")", "(", "[", "http://a.b/c", "<x:y>", "<!--", "-->", "word ", "\\", "[a]: b\n"]) for _ in range(rng.randrange(16)))
        found = markdown.spans(text)
        assert all(0 <= a < b <= len(text) for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:])), repr(text)


def test_protected_ranges(spark):
    df = spark.createDataFrame([(1, "say `code` now \U0001f600 `x` "), (2, None)], "k int, text string")
    found = {r["k"]: r["syntax"] for r in markdown.with_spans(df).collect()}
    assert found[2] is None and [(s["start"], s["end"]) for s in found[1]] == [(4, 10), (17, 20)]
    at = markdown.with_spans(df).select("k", markdown.protected(F.col("syntax"), F.lit(5), F.lit(9)).alias("a"), markdown.protected(F.col("syntax"), F.lit(10), F.lit(12)).alias("b"), markdown.protected(F.col("syntax"), F.lit(11), F.lit(14)).alias("c"))
    assert sorted(map(tuple, at.collect())) == [(1, True, True, False), (2, False, False, False)]
    assert "Exchange" not in markdown.with_spans(df)._jdf.queryExecution().executedPlan().toString()
