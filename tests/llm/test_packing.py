from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivener.llm import packing


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def pieces(library, texts, capacity):
    """(doc, piece, start, ids) by the library itself."""
    out = []
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        out += [(k, i, a, ids[a : a + capacity]) for i, a in enumerate(range(0, len(ids), capacity))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["don't", "<|endoftext|>", "İΣς", "é", "é", "a\x1cb", " ", "12.5", "×", "ÀÉ", "'", "'S", "\U0001f600"]), st.text(max_size=8)), max_size=12), st.sampled_from([" ", "", "\n", "  "]))
def test_ids_are_the_library_s(parts, gap):
    enc = packing.encoder(packing.VOCABULARY)
    text = gap.join(parts)
    assert np.frombuffer(enc.text(text), "<u2").tolist() == enc.library.encode(text, add_special_tokens=False).ids


def check_plan(counts, capacity):
    plan = packing.rounded(counts, packing.solve(counts, capacity), capacity)
    held = np.zeros_like(counts)
    for many, configuration in plan:
        assert many > 0 and sum(a * b for a, b in configuration) <= capacity
        for length, each in configuration:
            held[length] += many * each
    assert (held == counts).all()
    return sum(many for many, _ in plan)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_every_piece_once(wanted):
    counts = np.zeros(65, np.int64)
    for length, n in wanted.items():
        counts[length] = n
    used = check_plan(counts, 64)
    solution = packing.solve(counts, 64)
    assert used >= solution.bound - 1e-6
    assert used <= np.ceil(solution.bound) * 1.25 + 2


def test_plans_reach_the_bound():
    counts = np.zeros(101, np.int64)
    counts[[51, 27, 26, 23]] = [100, 100, 100, 200]  # 51 + 26 + 23 and 51 + 27 leave nothing behind
    assert check_plan(counts, 100) <= 152
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 400, 5000), minlength=1001)
    assert check_plan(counts, 1000) <= np.ceil((counts * np.arange(1001)).sum() / 1000) + 2


def test_knapsack_like_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = rng.integers(0, 4, 13)
        counts[0] = 0
        values = rng.random(13)
        best = np.zeros(13)
        for length, n in enumerate(counts):
            for _ in range(n):
                best[length:] = np.maximum(best[length:], best[: 13 - length] + values[length])
        pack = packing.Knapsack(values, counts, 12) if counts.any() else None
        for room in range(13 if pack else 0):
            found = pack.filling(room)
            assert abs(pack.best[room] - best[room]) < 1e-9 and abs(sum(values[k] * m for k, m in found.items()) - best[room]) < 1e-9
            assert sum(k * m for k, m in found.items()) <= room and all(m <= counts[k] for k, m in found.items())


def check(rows, expected, capacity):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((d is None, d or 0, i, a, len(ids), zlib.crc32(np.array(ids, "<u4"))) for d, i, a, ids in expected)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs, library):
    expected = [(odd_rows[k][0], i, a, ids) for k, i, a, ids in pieces(library, [r[1] for r in odd_rows], packing.CAPACITY)]
    rows = packing.digest(packing.pack(odd_docs)).collect()
    used = check(rows, expected, packing.CAPACITY)
    assert used <= np.ceil(sum(len(x[3]) for x in expected) / packing.CAPACITY) + 1
    assert packing.digest(packing.pack(no_docs)).collect() == []


@pytest.mark.parametrize("rows", [packing.BROADCAST_ROWS, 0])
def test_sequences_give_the_texts_back(spark, sf_dir, library, monkeypatch, rows):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = packing.pack(docs, capacity=512)
    expected = [(list(texts)[k], i, a, ids) for k, i, a, ids in pieces(library, texts.values(), 512)]
    used = check(packing.digest(packed).collect(), expected, 512)
    total = sum(len(x[3]) for x in expected)
    assert used <= 1.02 * np.ceil(total / 512)
    ids: dict = {}
    for s in packing.sequences(packed).collect():
        whole = np.frombuffer(s["ids"], "<u2")
        for doc, a, b in zip(s["doc_ids"], s["starts"], [*s["starts"][1:], len(whole)]):
            ids.setdefault(doc, []).append(whole[a:b].tolist())
    for doc, _, _, own in expected:
        assert own in ids[doc]
