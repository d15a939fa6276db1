from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from scrivener.llm import simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints):
    """doc_id -> smallest doc_id reachable over distances of at most three."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {(doc, value): least[root(i)] for i, (doc, value) in enumerate(prints)}


@pytest.mark.parametrize("text", [None, "", " \t\v ", "One", "one two", "a b c", "A B C d e", "Ä b c d\x1ce f", "x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_odd_documents(spark, odd_docs, odd_rows):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[r[0]]["fingerprint"] == f"{plain_fingerprint(r[1]):016x}" for r in odd_rows)
    assert {by_id[k]["component_id"] for k in (0, 1, 2)} == {0} and by_id[9]["component_id"] == by_id[8]["component_id"] == 8


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def links_of(spark, values):
    """Components of given fingerprints through both link stages."""
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)]
    distinct = spark.createDataFrame(signed, "first long, fp long")
    near = simhash.components(simhash.near_links(distinct.select("fp")))
    from pyspark.sql import functions as F

    grouped = distinct.join(near, distinct.fp == near.node, "left").select("first", "fp", F.coalesce("comp", "fp").alias("comp"))
    far = simhash.components(simhash.far_links(grouped.select("fp", "comp")))
    joined = grouped.join(far, grouped.comp == far.node, "left").select("first", F.coalesce(far.comp, grouped.comp).alias("comp")).collect()
    heads = {}
    for r in joined:
        heads[r["comp"]] = min(heads.get(r["comp"], r["first"]), r["first"])
    return {r["first"]: heads[r["comp"]] for r in joined}


@pytest.mark.parametrize("bound", [simhash.BROADCAST_KEYS, 0])
def test_every_distance(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", bound)
    rng = random.Random(1)
    values = []
    for d in range(7):
        for _ in range(30):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            values += [a, b]
    values = list(dict.fromkeys([0, (1 << 64) - 1, 1 << 63, 7, *values]))
    expected = plain_components(list(enumerate(values)))
    assert links_of(spark, values) == {k: expected[k, v] for k, v in enumerate(values)}


def test_chains_and_a_dense_group(spark):
    rng = random.Random(2)
    chain = [rng.getrandbits(64)]
    for k in range(40):  # each three bits from the one before
        chain.append(chain[-1] ^ 7 << (3 * k % 60))
    centre = rng.getrandbits(64)
    dense = [centre ^ rng.getrandbits(10) << 20 for _ in range(400)]
    values = list(dict.fromkeys(chain + dense))
    expected = plain_components(list(enumerate(values)))
    assert links_of(spark, values) == {k: expected[k, v] for k, v in enumerate(values)}


@pytest.mark.parametrize("bound", [simhash.BROADCAST_ROWS, 0])
def test_representatives_of_rows_that_share_ids(spark, odd_docs, no_docs, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    texts = ["one two three four five six", "one two three four five six", "quite another text of seven words here"]
    rows = [(7, texts[0], 1), (7, texts[1], 2), (7, texts[2], 3), (None, texts[0], 4), (None, texts[2], 5), (9, texts[0], 6), (9, None, 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    kept = sorted(r["number"] for r in simhash.representatives(docs).collect())
    assert kept == [1, 3, 7] and simhash.representatives(docs).columns == docs.columns
    assert simhash.representatives(no_docs).collect() == []
    prints = {plain_fingerprint(r["text"]) for r in odd_docs.collect()}
    assert len({plain_fingerprint(r["text"]) for r in simhash.representatives(odd_docs).collect()}) == simhash.representatives(odd_docs).count() <= len(prints)
