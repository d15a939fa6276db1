from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from scrivener.llm import langid

SAMPLES = {
    "de": ["Der schnelle braune Fuchs springt über den faulen Hund.", "Ich weiß nicht, was soll es bedeuten."],
    "en": ["The quick brown fox jumps over the lazy dog.", "What is it that the others know of this?"],
    "fr": ["Le renard brun saute par-dessus le chien paresseux.", "Où êtes-vous allés pendant l'été ?"],
}


def plain_bits(counts, context, byte):
    """Code length by the definition, for one language's counts of four-grams."""
    for order in (3, 2, 1, 0):
        c = context[3 - order :]
        seen = Counter()
        for gram, n in counts.items():
            if gram[3 - order : 3] == c:
                seen[gram[3]] += n
        if not seen:
            continue
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (n + d)) + plain_bits.paid
        plain_bits.paid += -math.log2(d / (n + d))
    return 8.0 + plain_bits.paid


def trees_and_counts():
    counts = {lang: Counter(bytes(x) for t in texts for x in zip(*(langid.folded(t)[k:] for k in range(4)))) for lang, texts in SAMPLES.items()}
    langs = sorted(SAMPLES)
    codes = sorted({int.from_bytes(g) for c in counts.values() for g in c})
    table = np.array([[counts[lang][c.to_bytes(4)] for lang in langs] for c in codes], dtype=float)
    return langs, counts, langid.Trees.build(langs, np.array(codes, dtype=np.uint32), table)


def test_code_lengths_by_definition():
    langs, counts, trees = trees_and_counts()
    for text in ("the dog knows", "über zzz", "qqq", "été 中"):
        data = langid.folded(text)
        codes = langid.grams(np.frombuffer(data, dtype=np.uint8))
        found = trees.bits(codes)
        for k, code in enumerate(codes.tolist()):
            gram = code.to_bytes(4)
            for j, lang in enumerate(langs):
                plain_bits.paid = 0.0
                assert found[k, j] == pytest.approx(plain_bits(counts[lang], gram[:3], gram[3]), rel=1e-5), (text, gram, lang)


def test_texts_are_scored_alone():
    langs, _, trees = trees_and_counts()
    texts = ["The dog is lazy", None, "", "123 ...", "der Hund ist faul", "le chien", "a"]
    together = trees.score(texts)
    assert together == [trees.score([t])[0] for t in texts]
    assert [lang for lang, _ in together[:6]] == ["en", "und", "und", "und", "de", "fr"]
    assert all(0 <= p <= 1 for _, p in together)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.98 * len(found)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    found = langid.identify(odd_docs).collect()
    assert len(found) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in found}
    assert {by_id[k]["lang_pred"] for k in (0, 1, 2, 3)} == {"und"} and by_id[0]["score"] == 0
    assert all(r["lang_pred"] in ("en", "de", "und") for r in found)
    assert langid.identify(no_docs).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first()["lang_pred"] == "und"


def test_repeated_rows_are_learned_from_once(spark):
    rows = [(k, t, lang) for lang, texts in SAMPLES.items() for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:1] * 500 + [(None, rows[1][1], "de")] * 50, "doc_id long, text string, lang string")
    once = spark.createDataFrame(rows + [(None, rows[1][1], "de")], "doc_id long, text string, lang string")
    texts = [t for _, t, _ in rows] + ["hund", "fox", "chien"]
    assert langid.learn(docs).score(texts) == langid.learn(once).score(texts)
