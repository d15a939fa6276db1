from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrivener.llm import phrases as ph


def plain(rows, least, listed):
    """By definition: rows (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in held.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inner[p[i:j]] = max(inner[p[i:j]], a)
        found = []
        for p, a in held.items():
            if 100 * inner[p] < 100 * a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], n[lang]))
        found.sort()
        out += [(lang, i + 1, p.decode(), a, l, r, m, -s) for i, (s, _, p, a, l, r, m) in enumerate(found[:listed])]
    return sorted(out)


def found(df, least, listed):
    return sorted(tuple(r) for r in ph.collocations(df, least, listed).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, many):
    rng = np.random.default_rng(seed)
    words = [*"abcdefgh", "New", "york", "été", "中文", "a|b", "x\x1cy"]
    weights = 1.0 / np.arange(1, len(words) + 1)
    out = []
    for k in range(many):
        own = rng.choice(words, rng.integers(0, 40), p=weights / weights.sum())
        gaps = rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "\r\n"], len(own), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        out.append((["en", "de", None, "und"][k % 4], "".join(w + g for w, g in zip(own, gaps))))
    return out + [("en", "the same line again and again the same line")] * 30 + [("fr", "b b b b b b b b")] * 5


@pytest.fixture(params=["sent", "joined", "dealt", "small blocks"])
def mode(request, monkeypatch):
    if request.param == "joined":
        monkeypatch.setattr(ph, "VOCABULARY", 0)
    if request.param == "dealt":
        monkeypatch.setattr(ph, "BUCKET", 50)
    if request.param == "small blocks":
        monkeypatch.setattr(ph, "BLOCK", 64)
        monkeypatch.setattr(ph, "COUNTED", 3)
    return request.param


def test_like_brute_force(spark, mode):
    rows = texts(1, 400)
    df = spark.createDataFrame([(k, lang, text, 1, 2) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase int").repartition(3)
    assert found(df, 5, 50) == plain(rows, 5, 50)
    assert found(df, 12, 10**6) == plain(rows, 12, 10**6)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    assert found(odd_docs, 2, 300) == plain([(r[2], r[1]) for r in odd_rows], 2, 300)
    assert found(no_docs, 2, 300) == []


def test_fragments_hold_each_occurrence_once():
    rng = np.random.default_rng(3)
    numbers = rng.integers(-2, 7, 5000).astype(np.int32)
    rows, counts = ph.fragments(numbers)
    again, same = ph.unpacked(ph.packed(rows, counts))
    assert (again == rows).all() and (same == counts).all()
    mined = Counter()
    for grams, n in ph.mine(rows, counts, np.zeros(len(rows), bool), 10**9):
        for g, k in zip(map(tuple, grams.tolist()), n.tolist()):
            assert g not in mined
            mined[g] = k
    expected = Counter()
    for size in range(2, 6):
        for k in range(len(numbers) - size + 1):
            g = tuple(numbers[k : k + size].tolist())
            if min(g) >= 0:
                expected[g] += 1
    assert mined == expected


def test_long_word_numbers():
    rng = np.random.default_rng(4)
    rows = rng.integers(-1, 2**31 - 1, (300, 5))[rng.integers(0, 300, 2000)].astype(np.int64)
    first, n, group = ph.summed(rows + 1, np.ones(2000, np.int64))
    assert Counter(map(tuple, rows.tolist())) == {tuple(rows[a].tolist()): k for a, k in zip(first, n.tolist())}
    assert (rows[first[group]] == rows).all()


def test_exact_arithmetic(spark):
    rows = [("en", "a b " * 60_000)] * 2
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, 100, 10) == plain(rows, 100, 10)
