from __future__ import annotations

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from scrivener import registry
from scrivener.functions import completion, spans, text
from scrivener.operators import protect, tokens

CLASSES = {
    "": "mixed", "```js": "code", "`x`": "code", "nmap": "code", "sqlmap": "code", "return": "code", "a=b": "code", "https://example.com": "url", "HTTP://x": "url",
    "user@example.com": "email", "/etc/passwd": "path", "./a": "path", "C:\\x": "path", "42": "number", "4.2": "number", "CVE": "identifier", "camelCase": "identifier",
    "PascalCaseClass": "identifier", "snake_case": "identifier", "CVE-2024-1234": "mixed", "h\u00e9llo": "mixed", "Teh": "mixed", "teh": "word", "it's": "word", " teh\n": "word", "'tis": "mixed", "returned": "word", "x\n": "word",
}


def values(spark, rows, column):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    return [r["v"] for r in df.select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def test_classes(spark):
    assert dict(zip(CLASSES, values(spark, list(CLASSES), text.token_type))) == CLASSES


@pytest.mark.parametrize(
    ("t", "offset", "expected"),
    [("teh ", 4, ("teh", 0, 3)), ("hello teh ", 10, ("teh", 6, 9)), ("hello, teh.", 11, ("teh", 7, 10)), ("", 0, None), ("   ", 3, None), (".", 1, None), ("foo . ", 6, None), ("foo(bar ", 8, ("bar", 4, 7)), ("a b", 99, ("b", 2, 3)), ("a b", -3, None)],
)
def test_token_before(spark, t, offset, expected):
    (found,) = values(spark, [t], lambda c: text.token_before(c, F.lit(offset)))
    assert (None if found is None else tuple(found)) == expected


def test_final_and_placed_tokens_agree(spark):
    docs = spark.createDataFrame([(1, "Hello, teh (wrld) foo(bar baz. end: x\ty!? last"), (2, ""), (3, None), (4, "... :: a\U0001f600b c"), (5, "trail ")], "doc_id long, text string")
    final = [(r["doc_id"], r["token"]) for r in tokens.final_tokens(docs, "doc_id").collect()]
    placed = sorted((r["doc_id"], r["start"], r["token"], r["end"]) for r in tokens.placed_tokens(docs, "doc_id").collect())
    assert sorted(final) == sorted((d, t) for d, _, t, _ in placed)
    assert [t for d, _, t, _ in placed if d == 1] == ["Hello", "teh", "wrld", "bar", "baz", "end", "x", "y"]
    assert [p[1:] for p in placed if p[0] == 4] == [(7, "a\U0001f600b", 10)]


def test_replay_fires_for_every_delimiter(spark):
    docs = spark.createDataFrame([("foo, a.b",)], "text string")
    assert [(r["offset"], r["token"]) for r in tokens.replayed_tokens(docs).orderBy("offset").collect()] == [(4, "foo"), (5, "foo"), (7, "a")]


def test_replay_like_a_look_back_at_every_delimiter(spark):
    some = random.Random(4)
    texts = ["".join(some.choices("abé\U0001f600.:,!)( [\t\n }{]?;;..))  ", k=some.randrange(50))) for _ in range(400)]
    texts += [None, "", "..a", "a)..b ", "(.b) ", "a) .b ", "abc).b).c ", "a\u3000. ", "x" * 600 + ". ", "!" * 3000 + "." * 3000 + "a ", "a" + " " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    at = F.explode(F.sequence(F.lit(1), F.length("text")))
    plain = docs.where("text <> ''").select("id", "text", at.alias("offset")).where(F.substring("text", F.col("offset"), F.lit(1)).isin(list(" \n\t.,!?;:)]}")))
    plain = plain.select("id", "offset", text.token_before(F.col("text"), F.col("offset")).alias("t")).select("id", "offset", "t.*")
    found = tokens.replayed_tokens(docs, "id")
    assert found.columns == plain.columns and found.count() == plain.count()
    assert found.exceptAll(plain).count() == 0


def test_replay_of_a_long_text_is_linear(spark):
    def took(words):
        docs = spark.createDataFrame([("ab. " * words,)], "text string")
        began = time.time()
        assert tokens.replayed_tokens(docs).agg(F.count("token"), F.max("offset")).first() == (2 * words, 4 * words)
        return time.time() - began

    took(100)
    assert took(150_000) < 15  # looking back from every delimiter took minutes


def test_protected_places(spark):
    docs = spark.createDataFrame([(1, "a\n```\nb\n```\nc\n  ~~~x\nd")], "doc_id long, text string")
    assert [r["fenced"] for r in protect.lines(docs).orderBy("number").collect()] == [False, True, True, True, False, True, True]
    cases = {"x `a b` y": (3, 4, True), "x \\`a` y": (4, 5, False), "see [t](http://x y) z": (8, 12, True), "https: x": (0, 5, True), "$ rm x": (2, 4, True), "git push now": (4, 8, True), "git": (0, 3, False), "# git push": (2, 5, False), "plain words": (0, 5, False)}
    rows = [(line, *c) for line, c in cases.items()]
    df = spark.createDataFrame(rows, "line string, a int, b int, expected boolean")
    found = df.withColumn("got", protect.in_protected_place(F.col("line"), F.col("a"), F.col("b"), F.lit(False))).collect()
    assert [(r["line"], r["got"]) for r in found] == [(r["line"], r["expected"]) for r in found]


def test_guards_are_those_of_each_place(spark):
    some = random.Random(6)
    parts = ["a", "b.c", "`", "\\", "\\`", " ", " ", " ", ". ", ":", "](", ")", "(", "[", "http:", "HTTPS: ", "ftp::", "http://x ", "é", "\U0001f600", ", ", "..", "$ ", "git "]
    lines = ["".join(some.choices(parts, k=some.randrange(24))) for _ in range(1500)] + ["", "x" * 5000, "`a` " * 50, "[t](http://x y) z "]
    rows = spark.createDataFrame([(n, line, n % 5 == 0) for n, line in enumerate(lines)], "n long, line string, fenced boolean")
    line, a, b = F.col("line"), F.col("start"), F.col("end")
    flags = protect.in_inline_code(line, a, b).alias("code"), protect.in_link_target(line, a).alias("link"), protect.is_scheme(line, a, b).alias("scheme"), protect.in_protected_place(line, a, b, F.col("fenced")).alias("guarded")
    plain = tokens.placed_tokens(rows, "n", "line", "fenced", text="line").select("n", "start", *flags).orderBy("n", "start").collect()
    found = {r["n"]: r for r in rows.select("n", protect.guards(line).alias("g"), protect.guarded_counts(line, F.col("fenced")).alias("c")).collect()}
    for n in range(len(lines)):
        own = [r for r in plain if r["n"] == n]
        assert [tuple(g) for g in found[n]["g"]] == [(r["code"], r["link"], r["scheme"]) for r in own], lines[n]
        assert tuple(found[n]["c"]) == (len(own), *(sum(r[c] for r in own) for c in ("code", "link", "scheme", "guarded"))), lines[n]
    assert all(any(r[c] for r in plain) for c in ("code", "link", "scheme"))


def test_guards_of_a_long_line_are_linear(spark, tmp_path):
    from scrivener.plans import memory

    spark.createDataFrame([(1, "`ab [c](d) " * 20_000), (2, "x" * 100_000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    found = [tuple(r) for r in memory.guarded_tokens(spark, str(tmp_path)).collect()]
    assert [r[:2] for r in found] == [(1, 60_000)] and time.time() - began < 20  # looking at the whole line for every token took minutes


def test_ranges(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    lit = F.lit
    assert one(spans.replaced(lit("abc def"), lit(4), lit(7), lit("xy"))) == "abc xy"
    assert one(spans.still_matches(lit("a teh b"), lit(2), lit(5), lit("teh"))) is True
    assert one(spans.still_matches(lit("a tehs b"), lit(2), lit(5), lit("teh"))) is False
    assert one(spans.still_matches(lit("a teh b"), lit(2), lit(50), lit("teh"))) is False
    assert [one(spans.moved(lit(x), lit(2), lit(5), lit(1))) for x in (1, 3, 9)] == [1, 3, 7]
    assert one(spans.escaped(lit("<a href='x'>&\"</a>"), True)) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"
    assert [one(spans.clamp(lit(x).cast("double"), lit(5))) for x in (-1, 2.7, 9, None)] == [0, 2, 5, 0]


def test_completions(spark):
    def clean(t, before="", stops=(), most=220):
        array = F.array(*[F.lit(s) for s in stops]) if stops else F.expr("cast(array() as array<string>)")
        return spark.range(1).select(completion.sanitized(F.lit(t), F.lit(before), array, most).alias("v")).first()["v"]

    assert clean("  \n ") == ""
    assert clean('"quoted text"') == "quoted text"
    assert clean('"a" or "b"') == '"a" or "b"'
    assert clean("go on. STOP here", stops=("", "STOP")) == "go on."
    assert clean("world again", "hello world") == " again" or clean("world again", "hello world") == "again"
    assert clean("a \r\n\r\n\r\n\r\nb") == "a\n\nb"
    assert clean(" next", "word") == " next" and clean(" next", "word ") == "next" and clean("  !", "word") == "!"
    assert clean("abcdef", most=3) == "abc"


def test_context(spark):
    def at(cursor, before, after, most=None):
        return tuple(spark.range(1).select(completion.context(F.lit("line one\nline two"), F.lit(cursor), before, after, most).alias("c")).first()["c"])

    assert at(13, 2000, 300) == ("line one\nline", " two", "line", 13)
    assert at(13, 4, 2) == ("line", " t", "line", 4)
    assert at(99, 3, 2) == ("two", "", "two", 3)
    assert at(13, 6, 6, 8) == ("e\nline"[-6:], " t", "line", 6)


def test_pasted_text_is_escaped_whole(spark, tmp_path):
    texts = ["a < b & c\r\n" * 40, 'x > "y"\r' * 40, "&amp;", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["html"] for r in registry.QUERIES["pasted_html"](spark, str(tmp_path)).collect()}
    assert found == {k: t if t is None else html.escape(t.replace("\r\n", "\n").replace("\r", "\n"), quote=False).replace('"', "&quot;") for k, t in enumerate(texts)}


def test_running_sums_and_places(spark):
    for n in (0, 1, 63, 64, 65, 200, 1000):
        numbers = [k * 5 % 7 for k in range(n)]
        got = spark.createDataFrame([(numbers,)], "x array<int>").select(text.running(F.col("x"))).first()[0]
        assert got == [sum(numbers[: k + 1]) for k in range(n)]
    t = "a, b\U0001f600c  (dd) "
    got = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(text.placed(F.col("t"), tokens.RUN)).collect()
    assert [(p["piece"], p["start"]) for p in got[0][0]] == [("a", 0), ("b\U0001f600c", 3), ("dd", 9)] and got[1][0] == [] and not got[2][0]


def test_rows_of_one_key_keep_their_own_places(spark):
    docs = spark.createDataFrame([(1, "aa bb cc "), (1, "dddd eeee ")], "doc_id long, text string")
    found = sorted((r["token"], r["start"], r["end"]) for r in tokens.placed_tokens(docs, "doc_id").collect())
    assert found == [("aa", 0, 2), ("bb", 3, 5), ("cc", 6, 8), ("dddd", 0, 4), ("eeee", 5, 9)]
    lines = spark.createDataFrame([(1, "a\n```\nb"), (1, "c\nd")], "doc_id long, text string")
    assert sorted((r["line"], r["number"], r["fenced"]) for r in protect.lines(lines, "doc_id").collect()) == [("```", 2, True), ("a", 1, False), ("b", 3, True), ("c", 1, False), ("d", 2, False)]


def test_rule_keys_as_in_addresses(spark):
    got = spark.createDataFrame([("never", "a b:c", "\u00fc!'()*~-_.+%")], "s string, o string, r string").select(text.rule_key(F.col("s"), F.col("o"), F.col("r"))).first()[0]
    assert got == "never:a%20b%3Ac:%C3%BC!'()*~-_.%2B%25"


def test_redacted_contexts_keep_the_limit(spark):
    df = spark.createDataFrame([("one two three",)], "t string")
    found = df.select(completion.context(F.col("t"), F.lit(7), 4, 3, 5, redact=lambda a, b: (F.concat(a, F.lit("****")), b)).alias("c")).first()["c"]
    assert (found["context_before"], found["context_after"], found["cursor_offset"]) == ("o****", "", 5)


def test_visible_text_of_pages(spark):
    page = "<p>a &lt;b&gt; <!-- no --><span class='x' data-ghost='1'>ghost <b>g</b></span>c</p><script>var x = '<p>';</script><div>d&amp;amp;</div>"
    assert spark.createDataFrame([(page,)], "h string").select(text.visible(F.col("h"))).first()[0] == "a <b> cd&amp;"


def test_overlap_like_brute_force(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abé", k=rng.randrange(12))), "".join(rng.choices("abé", k=rng.randrange(12)))) for _ in range(300)]
    pairs += [("x" * 500, "x" * 700), ("ab" * 300, "ba" * 200), ("one two", "two three"), ("", "a"), ("a", ""), ("\U0001f600b", "b\U0001f600"), ("z\U0001f600b", "\U0001f600b!")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    found = {r["k"]: r["n"] for r in df.select("k", completion.overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert found == {k: max((n for n in range(1, min(len(a), len(b)) + 1) if a[-n:] == b[:n]), default=0) for k, (a, b) in enumerate(pairs)}
