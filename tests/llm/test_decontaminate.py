from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scrivener.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, items):
    """(n_words, hit positions, items) by comparing every window at every position."""
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else ():
            window = w[k : k + 10]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item)
    return len(words), hit, found


def searched(text, items):
    tables = dc.searchers([(i, b.encode()) for i, b in items if b is not None])
    n, ranges, found = dc.search(None if text is None else text.encode(), tables)
    return n, {k for a, b in ranges for k in range(a, b)}, found


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_like_brute_force(data):
    words = st.sampled_from(["a", "b", "ab", "A", "é", "42", "long-er", "x.", "aa"])
    item = st.lists(words, max_size=14).map(" ".join)
    items = list(enumerate(data.draw(st.lists(item, max_size=4))))
    items = [(str(k), b) for k, b in items]
    text = " ".join(data.draw(st.lists(words, max_size=60)))
    if items:
        text += " " + items[0][1] + ", " + items[0][1]
    assert searched(text, items) == plain(text, items)


def test_overlapping_windows_and_copies():
    body = "one two three four five six seven eight nine ten eleven twelve"
    items = [("1", body), ("2", body), ("3", "seven"), ("4", "!!")]
    assert searched(body, items) == plain(body, items)
    assert searched("x " + body[:40], items) == plain("x " + body[:40], items)


def rows_of(found):
    return {r["doc_id"]: r for r in dc.digest(found).collect()}


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "hello world"), (2, None), (None, "hello"), (3, "a b c d e f g"), (3, "quick brown"), (4, ""), (10, "World")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = [(str(i), b) for i, b in items if i is not None]
    found = dc.digest(dc.decontaminate(odd_docs, benchmark)).collect()
    assert len(found) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in found}
    for doc in odd_rows:
        n, hit, names = plain(doc[1], known) if len(doc[1] or "") < 1000 else (by_id[doc[0]]["n_words"], set(), set())
        r = by_id[doc[0]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert dc.decontaminate(no_docs, benchmark).collect() == []
    assert all(r["n_hit"] == 0 for r in dc.decontaminate(odd_docs, benchmark.limit(0)).collect())


def test_a_benchmark_of_many_passes(spark, odd_docs, monkeypatch):
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(["hello world", "a b c d e f g", "b c d", "quick", "dog it sleeps"])], "item_id long, text string")
    whole = rows_of(dc.decontaminate(odd_docs, benchmark))
    monkeypatch.setattr(dc, "PASS_BYTES", 12)
    assert rows_of(dc.decontaminate(odd_docs, benchmark)) == whole


def test_clean_rows_in_many_passes(spark, odd_docs, monkeypatch):
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(["hello world", "a b c d e f g", "b c d", "quick", "dog it sleeps"])], "item_id long, text string")
    hit = {r["doc_id"] for r in dc.decontaminate(odd_docs, benchmark).where("n_hit > 0").collect()}
    expected = sorted(map(repr, odd_docs.where(~odd_docs.doc_id.isin(list(hit)) | odd_docs.doc_id.isNull()).collect()))
    for size in (dc.PASS_BYTES, 12):
        monkeypatch.setattr(dc, "PASS_BYTES", size)
        left = dc.without_hits(odd_docs, benchmark)
        assert left.columns == odd_docs.columns and sorted(map(repr, left.collect())) == expected
