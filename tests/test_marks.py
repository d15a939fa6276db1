from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import decide, marks, protect, tokens


def setup(spark):
    docs = spark.createDataFrame([(1, "teh cat adn teh dog."), (2, "nothing here "), (3, "(thier) end")], "doc_id long, text string")
    decided = decide.decisions(spark.createDataFrame([("teh",), ("adn",), ("thier",)], "token string"))
    return docs, marks.edits(docs, decided)


def test_corrections_and_reverts(spark):
    docs, edited = setup(spark)
    fixed = marks.corrected(docs, edited)
    assert {r["doc_id"]: (r["text"], r["n_edits"]) for r in fixed.collect()} == {1: ("the cat and the dog.", 3), 3: ("(their) end", 1)}
    done = marks.transactions(edited)
    assert [(r["new_start"], r["new_end"]) for r in done.where("doc_id = 1").orderBy("start").collect()] == [(0, 3), (8, 11), (12, 15)]
    back = marks.reverted(fixed, done).where("doc_id = 3").first()
    assert (back["result"], back["text"]) == ("reverted", "(thier) end")
    stale = marks.reverted(fixed.withColumn("text", F.lit("x")), done)
    assert {r["result"] for r in stale.collect()} == {"stale_range"}


def test_marks_move_or_go(spark):
    edited = spark.createDataFrame([(1, 0, 3, "long word"), (1, 10, 12, "")], "doc_id long, start int, end int, replacement string")
    placed = spark.createDataFrame([(1, 4, 6, "a"), (1, 2, 5, "b"), (1, 11, 14, "c"), (1, 20, 22, "d"), (2, 1, 2, "e")], "doc_id long, mark_start int, mark_end int, kind string")
    assert sorted(map(tuple, marks.shifted(placed, edited).collect())) == [(1, 10, 12, "a"), (1, 24, 26, "d"), (2, 1, 2, "e")]


def test_survival(spark):
    placed = spark.createDataFrame([(1, 0, 2, "ab", 1), (1, 3, 5, "cd", 2)], "doc_id long, mark_start int, mark_end int, original string, version int")
    now = spark.createDataFrame([(1, "ab xx", 2)], "doc_id long, text string, version int")
    assert [r["original"] for r in marks.surviving(placed, now, "version").collect()] == ["cd"]
    assert [r["original"] for r in marks.surviving(placed, now).collect()] == ["ab"]
    kinds = spark.createDataFrame([(1, 0, 2, "xy", "ab", "blue_a"), (1, 0, 2, "ab", None, "red_b"), (1, 3, 5, "xx", "cd", "blue_c")], "doc_id long, mark_start int, mark_end int, original string, replacement string, kind string")
    assert sorted(r["kind"] for r in marks.surviving(kinds, now, "decoration").collect()) == ["blue_a", "red_b"]


def test_overlaps_and_rendering(spark):
    x = spark.createDataFrame([(1, 0, 4), (1, 5, 6), (2, 0, 9)], "doc_id long, start int, end int")
    y = spark.createDataFrame([(1, 3, 5)], "doc_id long, start int, end int")
    assert [tuple(r) for r in marks.overlapping(x, y).collect()] == [(1, 0, 4, 3, 5)]
    df = spark.createDataFrame([("a<b cd", [(4, 6, "red_x"), (4, 6, "blue_y"), (0, 1, "red_z")])], "t string, m array<struct<start:int,end:int,kind:string>>")
    assert df.select(marks.rendered(F.col("t"), F.col("m"))).first()[0] == '<mark class="red_z">a</mark>&lt;b <mark class="blue_y">cd</mark>'


def test_rows_that_share_a_key(spark):
    docs = spark.createDataFrame([(1, "teh cat "), (1, "a long dog adn thier end "), (1, "teh cat "), (2, None)], "doc_id long, text string")
    decided = decide.decisions(spark.createDataFrame([("teh",), ("adn",), ("thier",)], "token string"))
    listed = marks.edit_lists(docs, decided)
    assert sorted(r["text"] for r in marks.corrected(docs, listed).collect()) == ["a long dog and their end ", "the cat ", "the cat "]
    edited = marks.edits(docs, decided)
    assert sorted((r["start"], r["original"], r["n"], r["shift"]) for r in edited.collect()) == [(0, "teh", 1, 0), (11, "adn", 1, 0), (15, "thier", 2, 0)]
    assert sorted(r["text"] for r in marks.corrected(docs, edited).collect()) == ["a long dog and their end ", "the cat ", "the cat "]


def test_nothing_is_shuffled_below_the_joins(spark):
    docs = spark.createDataFrame([(1, "teh cat ")], "doc_id long, text string")
    for df in (tokens.placed_tokens(docs, "doc_id"), tokens.placed_runs(docs, "doc_id"), protect.lines(docs, "doc_id")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_meet_once_across_bins(spark):
    rng = random.Random(4)
    draw = lambda: [(rng.randrange(3), a := rng.randrange(400), a + rng.choice((0, 1, 5, 64, 200))) for _ in range(60)]
    left, right = draw(), draw()
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, start int, end int")
    expected = sorted((k, a, b, c, d) for k, a, b in left for key, c, d in right if k == key and a < d and c < b)
    assert sorted(map(tuple, marks.overlapping(frame(left), frame(right)).collect())) == expected


def test_marks_without_their_transaction(spark):
    done = spark.createDataFrame([(1, "correction-1", "teh", "the", 0, 3)], "doc_id long, id string, original string, replacement string, new_start int, new_end int")
    placed = spark.createDataFrame([(1, 0, 3, "teh", "correction-1"), (1, 5, 8, "abc", "correction-9"), (1, 9, 10, "x", None)], "doc_id long, mark_start int, mark_end int, original string, event_id string")
    found = {r["mark_start"]: (r["known"], r["before"], r["replacement"], r["new_start"], r["new_end"]) for r in marks.with_transactions(placed, done).collect()}
    assert found == {0: (True, "teh", "the", 0, 3), 5: (False, "abc", "abc", 5, 8), 9: (False, "x", "x", 9, 10)}


def test_completions_revert_where_the_exact_text_stands(spark):
    texts = spark.createDataFrame([(1, "ab more cd"), (2, "ab MORE cd"), (3, "ab"), (4, "ab")], "doc_id long, text string")
    accepted = spark.createDataFrame([(1, 2, " more"), (2, 2, " more"), (3, 1, " long text")], "doc_id long, at int, inserted string")
    found = {r["doc_id"]: (r["result"], r["text"]) for r in marks.completion_reverted(texts, accepted).collect()}
    assert found == {1: ("reverted", "ab cd"), 2: ("stale_range", "ab MORE cd"), 3: ("stale_range", "ab"), 4: ("missing_transaction", "ab")}


@pytest.mark.parametrize("few", [marks.FEW, 0])
def test_corrections_found_by_pattern_and_by_join(spark, monkeypatch, few):
    monkeypatch.setattr(marks, "FEW", few)
    texts = ["teh cat, teh.", "teh", "teh ", "ateh teh: (teh) teh.. x", "teh.x teh", "a.b a.b. a.b, [teh]", "no fix here.", "", None, "été étés été!", "teh cat, teh."]
    docs = spark.createDataFrame([(k if k < 10 else 0, t) for k, t in enumerate(texts)], "doc_id long, text string")
    fixes = [("teh", "the"), ("a.b", "A B"), ("été", "summer"), ("(x", "never")]
    decided = spark.createDataFrame([(t, r, "auto_correct", 1.0, ["X"]) for t, r in fixes] + [("cat", "dog", "do_nothing", 1.0, [])], "token string, replacement string, action string, confidence double, reason_codes array<string>")
    found = marks.edits(docs, decided)
    rows = sorted((r["doc_id"], r["start"], r["end"], r["original"], r["replacement"], r["n"], r["shift"]) for r in found.collect())
    changed = {(r["doc_id"], r["text"], r["n_edits"]) for r in marks.corrected(docs, marks.edit_lists(docs, decided)).collect()}
    assert changed == {(r["doc_id"], r["text"], r["n_edits"]) for r in marks.corrected(docs, found).collect()}
    assert rows[:2] == [(0, 0, 3, "teh", "the", 1, 0), (0, 9, 12, "teh", "the", 2, 0)] and (0, "the cat, the.", 2) in changed
    assert {(d, t) for d, t, _ in changed if d in (1, 2, 3, 4)} == {(2, "the "), (3, "ateh the: (the) the.. x")}
    assert {(d, t) for d, t, _ in changed if d in (5, 6, 9)} == {(5, "a.b a.b. a.b, [the]")}  # the others look protected
    assert marks.edits(docs, decided.where("action = 'do_nothing'")).count() == 0


def test_suggestions_from_popovers(spark):
    texts = spark.createDataFrame([(1, "a tset here"), (2, "a tsets here"), (3, "tset")], "doc_id long, text string")
    red = spark.createDataFrame([(1, "m1", 2, 6, "tset", None, ["U"]), (2, "m1", 2, 6, "tset", None, None), (3, "m2", 0, 4, "tset", "Tset", None)], "doc_id long, mark_id string, mark_start int, mark_end int, mark_text string, original string, reason_codes array<string>")
    chosen = spark.createDataFrame([(1, "m1", "test"), (1, "m9", "x"), (2, "m1", "test"), (3, "m2", "set")], "doc_id long, mark_id string, suggestion string")
    rows = {(r["doc_id"], r["mark_id"]): r for r in marks.suggested(texts, red, chosen).collect()}
    assert {k: r["result"] for k, r in rows.items()} == {(1, "m1"): "applied", (1, "m9"): "missing_mark", (2, "m1"): "stale_range", (3, "m2"): "applied"}
    one, other = rows[1, "m1"], rows[3, "m2"]
    assert (one["text"], one["start"], one["new_end"], one["trigger"], one["confidence"], one["reason_codes"], one["mark"]) == ("a test here", 2, 6, "popover", 1.0, ["U"], "blue_applied_correction")
    assert (other["text"], other["original"], other["new_end"], other["reason_codes"]) == ("set", "Tset", 3, []) and rows[2, "m1"]["text"] == "a tsets here" and rows[2, "m1"]["trigger"] is None
