"""Token text as column expressions: trimming, keys, classes, and the token before an offset.

Offsets and lengths count code points, as Spark's ``length`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BOUNDARIES = r",!?;()\[\]{}"
DELIMITERS = " \n\t.,!?;:)]}"
CODE_WORDS = ("nmap", "sqlmap")
KEYWORDS = ("const", "let", "var", "function", "return", "class", "import", "export")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Numbers that are added up in one fold.
BLOCK = 64


def running(numbers: Column) -> Column:
    """Running sums of an array of integers, by folds over blocks of it: a fold that extends an array copies it, so none extends a long one."""
    empty = F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(0).cast("long").alias("sum"), empty.alias("sums"))
    add = lambda done, n: F.struct((done["sum"] + n).alias("sum"), F.concat(done["sums"], F.array(done["sum"] + n)).alias("sums"))
    folded = lambda part: F.aggregate(part, start, add, lambda done: done["sums"])

    def joined(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: folded(F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))
        whole = lambda b: let(folded(F.transform(b, lambda sums: F.element_at(sums, -1))), lambda upto: F.flatten(F.zip_with(b, upto, lambda sums, end: F.transform(sums, lambda v: v + end - F.element_at(sums, -1)))))
        return let(blocks, whole)

    return let(numbers, lambda x: F.when(F.size(x) > 0, joined(x)).otherwise(empty))


def placed(text: Column, pattern: str, part: int = 0) -> Column:
    """Array of struct (piece, start): what group ``part``, at its beginning, of each match of a pattern holds, and where it begins."""
    lengths = lambda strings: F.transform(strings, F.length)
    gaps = lengths(F.split(text, pattern, -1))  # one more than the matches

    def zipped(matched: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(matched)), matched, lambda a, b: a + b))
        pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(part))
        found = F.arrays_zip(pieces.alias("piece"), ends.alias("end"), matched.alias("size"))
        return F.transform(found, lambda m: F.struct(m["piece"].alias("piece"), (m["end"] - m["size"]).cast("int").alias("start")))

    return let(lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), zipped)


def visible(html: Column, ghost: str = "data-ghost") -> Column:
    """The text of a page: without comments, scripts, styles, tags, and the elements that carry the attribute ``ghost`` (and hold no elements of their kind)."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>", "")
    for tag in ("span", "div"):
        text = F.regexp_replace(text, rf"(?s)<{tag}\b[^>]*\b{ghost}\b[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def token_key(text: Column) -> Column:
    """The form under which dictionaries and rules hold a word."""
    return F.lower(trimmed(text))


def rule_key(status: Column, original: Column, replacement: Column) -> Column:
    """The key a rule is stored under: status and both words, percent-encoded, with colons between."""
    # Form encoding differs: a blank is a plus sign, and five marks that stay plain are encoded.
    plain = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}

    def encoded(word: Column) -> Column:
        out = F.url_encode(word)
        for a, b in plain.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.concat_ws(":", status, encoded(original), encoded(replacement))


def is_delimiter(char: Column) -> Column:
    return char.isin(list(DELIMITERS))


def is_code(t: Column) -> Column:
    """Fences, inline code, code words, keywords and code punctuation."""
    inline = (F.length(t) >= 2) & t.startswith("`") & t.endswith("`")
    keyword = t.rlike(r"(?<![A-Za-z0-9_])(?:" + "|".join(KEYWORDS) + r")(?![A-Za-z0-9_])")
    return t.startswith("```") | t.endswith("```") | inline | t.isin(*CODE_WORDS) | keyword | t.rlike("[=;{}]")


def is_path(t: Column) -> Column:
    return t.rlike(r"\A(?:/|~/|\.{1,2}/|[A-Za-z]:[\\/])") | t.contains("\\")


def is_identifier(t: Column) -> Column:
    """Capitals, camelCase, PascalCase and snake_case."""
    return t.rlike(r"\A(?:[A-Z]{2,}|[a-z]+(?:[A-Z][A-Za-z0-9]*)+|[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)\z")


def is_mixed(t: Column) -> Column:
    return t.rlike(r"[^\x00-\x7F]") | (t.rlike("[A-Za-z]") & t.rlike(r"[0-9\-_.:@/\\A-Z]"))


def class_of(t: Column) -> Column:
    """Class of a trimmed text: the first that fits."""
    return (
        F.when(t == "", "mixed")
        .when(is_code(t), "code")
        .when(t.rlike(rf"(?i)\Ahttps?://[^{SPACES}]+\z"), "url")
        .when(t.rlike(rf"\A[^{SPACES}@]+@[^{SPACES}@]+\.[^{SPACES}@]+\z"), "email")
        .when(is_path(t), "path")
        .when(t.rlike(r"\A[0-9]+(?:\.[0-9]+)?\z"), "number")
        .when(is_identifier(t), "identifier")
        .when(is_mixed(t), "mixed")
        .when(t.rlike(r"\A[a-z]+(?:'[a-z]+)?\z"), "word")
        .otherwise("mixed")
    )


def token_type(text: Column) -> Column:
    """Class of a token; only ``word`` is unprotected."""
    return let(trimmed(text), class_of)


def is_protected(text: Column) -> Column:
    return token_type(text) != "word"


def token_before(text: Column, offset: Column) -> Column:
    """The token that ends before ``offset``, as a struct (token, start, end), or null.

    One run of white space, then one run of closing marks is passed over; the
    token reaches back to the next boundary.  The offset is clamped to the text.
    """
    at = F.least(F.greatest(F.coalesce(offset, F.length(text)), F.lit(0)), F.length(text))
    before = F.regexp_replace(F.substring(text, F.lit(1), at), rf"[{SPACES}]+\z", "")
    before = F.regexp_replace(before, r"[.,!?;:)\]}]+\z", "")
    token = lambda b: F.regexp_extract(b, rf"[^{SPACES}{BOUNDARIES}]*\z", 0)
    placed = lambda t, end: F.when(t != "", F.struct(t.alias("token"), (end - F.length(t)).alias("start"), end.alias("end")))
    return let(before, lambda b: let(token(b), lambda t: placed(t, F.length(b))))
