from __future__ import annotations

import random
import re

from scrivener.llm import sentence_spans as ss

PASSAGE = "The committee met on a grey morning in March. It heard nine reports about the harbour, the mills and the roads. Nobody spoke against the plan. The vote was taken before noon, and the clerk wrote it down."
MARKS = ".!?,;:|\n\u2026\u3002\uFF01\uFF0C\uFF1F"
OWN = "This line belongs to document number {} alone and to no other one at all."


def cut(text):
    """Sentences and parts between commas, one character at a time."""
    found, now = [], ""
    for c in text:
        if now and now[-1] in MARKS and c not in MARKS:
            found.append(now)
            now = ""
        now += c
    return [*found, now] if now else found


def plain(rows):
    """(row number, sentences removed, text left) of every row that loses any: runs of every length, compared as words."""
    order = sorted((d is None, d or 0, k) for k, (d, t) in enumerate(rows) if t is not None)
    seen, out = set(), {}
    for *_, k in order:
        pieces = cut(rows[k][1])
        words = [re.findall(r"\w+", p.lower()) for p in pieces]
        covered = set()
        for a in range(len(pieces)):
            for b in range(a + ss.SENTENCES, len(pieces) + 1):
                run = tuple(w for ws in words[a:b] for w in ws)
                if words[a] and words[b - 1] and len(run) >= ss.WORDS:
                    covered |= set(range(a, b)) if run in seen else set()
                    seen.add(run)
        if covered:
            out[k] = len(covered), "".join(p for i, p in enumerate(pieces) if i not in covered)
    return out


def outcome(spark, rows):
    return sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in ss.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)


def expected(rows):
    return sorted(((rows[k][0], *found) for k, found in plain(rows).items()), key=repr)


def test_like_brute_force(spark):
    rows = [(k, f"{OWN.format(k)}\n{PASSAGE}\n{OWN.format(-k)}") for k in range(30)] + [(99, OWN.format("x") * 3), (100, PASSAGE + " " + PASSAGE), (101, None), (None, PASSAGE)]
    found = {r["doc_id"]: r for r in ss.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert outcome(spark, rows) == expected(rows)
    assert 0 not in found and "committee" not in found[5]["text"] and OWN.format(5) in found[5]["text"] and OWN.format(-5) in found[5]["text"]
    for d, r in found.items():
        whole = dict(rows)[d]
        gone = sum(s["end"] - s["start"] for s in r["spans"])
        assert len(r["text"]) == len(whole) - gone and (r["first_docs"] or d is None)


def test_spans_cover_the_text():
    for text in ("", "a", "...", "a. b! c", "\n\na\n\nb?!\n", "x | y; z: w"):
        spans = ss.sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_runs_are_long_enough_and_shortest():
    text = "One two three. Four. " * 12
    for a, b, words in ss.runs(text):
        assert b - a >= ss.SENTENCES and len(words.split()) >= ss.WORDS
        assert b - a == ss.SENTENCES or len(words.split()) - len(text[slice(*ss.sentences(text)[b - 1])].split()) < ss.WORDS


def test_odd_documents(odd_docs, no_docs):
    found = {r["doc_id"]: r["n_removed"] for r in ss.dedup_spans(odd_docs).collect()}
    assert set(found) <= {7}  # the long text repeats itself, nothing else is long enough
    assert ss.dedup_spans(no_docs).collect() == []


def test_like_runs_of_every_length(spark):
    rng = random.Random(8)
    pieces = [" ".join(rng.choices("abcdefghijklm", k=rng.choice((0, 1, 2, 3, 9, 14)))) + rng.choice((".", ",", "!\n", ".\n.")) + " " for _ in range(12)]
    passages = [rng.choices(pieces, k=rng.randrange(2, 9)) for _ in range(6)]
    rows = [(k, "".join([f"own words of {k} come here. ", *rng.choice(passages), f"and {k} again, ", *rng.choice(passages)])) for k in range(40)]
    assert outcome(spark, rows) == expected(rows)


def test_rows_that_share_a_doc_id_stay_apart(spark):
    rows = [(1, PASSAGE), (2, OWN.format("a") + " " + PASSAGE), (2, "Short."), (2, "Another long text of the same number. " + PASSAGE + " It ends here."), (None, PASSAGE), (None, "x. " + PASSAGE)]
    assert outcome(spark, rows) == expected(rows)
    copies = [(1, PASSAGE)] * 3
    assert [r[1:] for r in outcome(spark, copies)] == [(6, "")] * 2 and outcome(spark, copies) == expected(copies)


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(ss, "BROADCAST_IDS", 0)
    rows = [(k // 2 or None, f"{OWN.format(k)}\n{PASSAGE}") for k in range(20)]
    assert outcome(spark, rows) == expected(rows)


def test_short_repeats_stay(spark):
    licence = "Licensed under the terms of some licence, version two of it.\n"
    assert outcome(spark, [(k, licence + OWN.format(k)) for k in range(5)]) == []


def test_short_sentences_clauses_and_tails_go(spark):
    short = "Eighteen words are less than twenty words. Two whole sentences of them repeat in the later document here"
    clauses = "begins within a sentence, then it goes on in several clauses, which stand between two commas each, and ends"
    tail = "The first sentence of this passage has more than ten words in it. The second has many more words than the floor of a run asks for. So ends it."
    rows = [(1, f"One. {short}. Two."), (2, f"Three {clauses} four."), (3, f"Five. {tail}"), (4, f"Six. {short}. Seven."), (5, f"Eight {clauses} nine."), (6, f"Ten. {tail} Eleven is own.")]
    left = {r["doc_id"]: r["text"] for r in ss.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(left) == {4, 5, 6} and "clauses" not in left[5] and "two commas" not in left[5]
    assert "Eighteen" not in left[4] and "whole" not in left[4] and "So ends it" not in left[6] and "Eleven" in left[6]
