from __future__ import annotations

import random
import time
from itertools import combinations

import pytest

from scrivener.llm import url_rules as ur

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [
    None, "", "no scheme", "http://", "http://com/en/x", "HTTPS://WWW.Example.COM/en/71?q=1#f", "http://example.com/en/6", "http://notexample.com/en/7", "ftp://a.net/de/", "http://example.net/de/8",
    "http://x.example.net/de/88?a=b&c", "http://example.org/es/", "http://org?x=/es/", "http://example.org#/es/", "http://Ä.org/es/1", "http://host:80/en/", "a://b://com/en/", "http://.com/en/",
]


def test_path_rules(spark):
    rows = [(k, u, "h", "p", "r") for k, u in enumerate(URLS)] + [(5, URLS[5], None, None, None), (None, URLS[4], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = ur.judge(pages, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert ur.judge(pages.limit(0), labels).collect() == []


def plain_rules(transactions, support, confidence):
    """Pruned rules by counting every combination."""
    n = len(transactions)
    every, hits = {}, {}
    for tokens, blocked in transactions:
        for size in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), size):
                every[c] = every.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + blocked
    least = max(support, 2 / n) * n
    known = {c: hits[c] / every[c] for c in every if hits[c] >= least - 1e-9 and hits[c] / every[c] >= confidence}
    return {" ".join(c): v for c, v in known.items() if not any(known.get(tuple(t for t in c if t != gone), 0) >= v for gone in c if len(c) > 1)}


def test_mined_rules(spark):
    rows = []
    for k in range(200):
        tokens = ["h:x", f"k:{k % 3}", f"p:{k % 5}"]
        rows.append((tokens, k % 3 == 0 and k % 5 < 3))
    found = ur.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.02, 0.6).collect()
    expected = plain_rules(rows, 0.02, 0.6)
    assert {r["rule"]: pytest.approx(r["confidence"]) for r in found} == expected
    assert all(r["rarest"] in r["tokens"] for r in found)


def test_mined_verdicts(spark):
    pages = spark.createDataFrame([(k, f"http://{'spam' if k % 4 == 0 else 'fine'}.test/p{k}") for k in range(100)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(50)], "doc_id long, quality int, toxic int")
    verdicts = {r["page_id"]: r["verdict"] for r in ur.judge(pages, labels).collect()}
    assert verdicts == {k: "block" if k % 4 == 0 else "allow" for k in range(100)}


def test_many_parameters_of_a_repeated_url(spark):
    query = "&".join(f"key{k}=v{k}x" for k in range(15))
    urls = [f"https://shop.test/item?{query}" if k % 25 == 0 else f"https://site{k % 7}.test/p{k % 3}" for k in range(100)]
    pages = spark.createDataFrame(list(enumerate([*urls, "https://other.test/?key3=v3x", "https://other.test/?q=1"])), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 25 != 0), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    verdicts = {r["page_id"]: r["verdict"] for r in ur.judge(pages, labels).collect()}
    assert verdicts == {k: "block" if k % 25 == 0 and k < 100 or k == 100 else "allow" for k in range(102)}


def test_parameters_that_are_missing_now_and_then(spark):
    """Each page of a tracked link lacks one of its 25 parameters: near twins, which would make 2 ** 25 itemsets."""
    urls = []
    for k in range(150):
        query = "&".join(f"key{j}=v{j}x" for j in range(25) if j != k % 25)
        urls.append(f"https://shop.test/item?{query}" if k % 3 == 0 else f"https://site{k % 7}.test/p{k % 4}?key{k % 25}=other")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    began = time.time()
    verdicts = {r["page_id"]: r["verdict"] for r in ur.judge(pages, labels).collect()}
    assert verdicts == {k: "block" if k % 3 == 0 else "allow" for k in range(150)} and time.time() - began < 120


def test_near_twins_by_counting(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        base = {"a", "b", "c", "d"} if rng.random() < 0.5 else set()
        rows.append(sorted({t for t in base if rng.random() < 0.97} | {t for t in ("x", "y", "z") if rng.random() < 0.4}))
    frame = spark.createDataFrame(list(enumerate(rows)), "row long, tokens array<string>")
    twin = {r["token"]: r["twin"] for r in ur.twins(frame, 2).collect()}
    assert len({twin[t] for t in "abcd"}) == 1 and twin[twin["a"]] == twin["a"] and all(twin[t] == t for t in "xyz")


def brute_verdicts(pages, transactions, support, confidence):
    """The pages that hold all tokens of any pruned rule."""
    rules = [set(r.split(" ")) for r in plain_rules(transactions, support, confidence)]
    return [any(r <= set(p) for r in rules) for p in pages]


@pytest.mark.parametrize("bound", [0, 100_000])
def test_verdicts_like_every_combination(spark, monkeypatch, bound):
    monkeypatch.setattr(ur, "BROADCAST_RULES", bound)
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(9)]
    draw = lambda: sorted({t for t in vocabulary if rng.random() < 0.35} | ({"a1", "a2", "a3"} if rng.random() < 0.3 else set()))
    transactions = [(t, ("a1" in t and "t2" in t) or ("t4" in t and rng.random() < 0.8)) for t in (draw() for _ in range(120))]
    pages = [[*draw(), *rng.sample(["a1", "a2", "a3"], 1)] for _ in range(60)]
    rules = ur.mine(spark.createDataFrame(transactions, "tokens array<string>, blocked boolean"), 0.03, 0.6)
    frame = spark.createDataFrame(list(enumerate(map(lambda p: sorted(set(p)), pages))), "page long, tokens array<string>")
    found = {r["page"] for r in ur.matches(frame, rules, "page").collect()}
    assert [k in found for k in range(60)] == brute_verdicts(pages, transactions, 0.03, 0.6)
