from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scrivener.operators import decide, editor, requests
from scrivener.sources.storage import SCHEMA, ChangeLog


def test_delimiters_and_triggers(spark):
    rows = [("x ", "ab", 2), (None, "ab,", 3), ("x", "ab", 2), ("\n", "", 0)]
    df = spark.createDataFrame(rows, "data string, text string, caret int")
    d = editor.typed_delimiter(F.col("data"), F.col("text"), F.col("caret"))
    assert [(r["d"], r["t"]) for r in df.select(d.alias("d"), F.when(d.isNotNull(), editor.trigger(d)).alias("t")).collect()] == [(" ", "space"), (",", "punctuation"), (None, None), ("\n", "newline")]
    assert [r[0] for r in df.select(editor.typed_delimiter(F.col("data"), F.col("text"), F.col("caret"), False)).collect()] == [" ", None, None, "\n"]


def test_settings(spark):
    decided = decide.decisions(spark.createDataFrame([("teh",), ("zzzzword",), ("form",)], "token string"))

    def effects(**more):
        return {r["token"]: (r["effect"], r["shown_mark"], r["shown_suggestions"]) for r in editor.gated(decided, editor.Settings(**more)).collect()}

    assert effects() == {"teh": ("edit", "blue_applied_correction", None), "zzzzword": ("red_mark", "red_spelling_issue", []), "form": ("none", None, None)}
    assert effects(autocorrect=False)["teh"] == ("red_mark", "red_spelling_issue", ["the"])
    assert effects(autocorrect=False, spellcheck=False) == dict.fromkeys(["teh", "zzzzword", "form"], ("none", None, None))
    assert effects(keep_marks=False)["teh"] == ("edit", None, None)
    assert effects(applied_reasons=editor.TRUSTED)["teh"][0] == "edit" and effects(applied_reasons=("ALWAYS_CORRECT_RULE",))["teh"][0] == "red_mark"


def test_actions(spark):
    rows = [("always_correct", "omw", "on my way", None, 1), ("add_to_dictionary", None, None, "acme", 2), ("disable_autocorrect", None, None, None, 3), ("never_correct", "teh", "the", None, 4)]
    actions = spark.createDataFrame(rows, "type string, original string, replacement string, word string, at long")
    assert [tuple(r) for r in editor.reported(actions).collect()] == [("always_correct", "omw", "on my way", "saved"), ("add_to_dictionary", "acme", "", "saved"), ("disable_autocorrect", "", "", "session"), ("never_correct", "teh", "the", "saved")]
    words, rules = editor.memory_log(actions)
    assert [tuple(r) for r in words.collect()] == [("acme", 2)] and [r["status"] for r in rules.orderBy("created_at").collect()] == ["always", "never"]


def test_numbered_marks_and_guards(spark):
    marks = spark.createDataFrame([(1, 3, 5, "red_x"), (1, 0, 2, "red_x"), (1, 0, 2, "blue_y")], "doc_id long, start int, end int, kind string")
    assert sorted((r["n"], r["kind"], r["start"]) for r in editor.numbered(marks).collect()) == [(1, "blue_y", 0), (2, "red_x", 0), (3, "red_x", 3)]
    assert [r["start"] for r in editor.numbered(marks, kind="red_x").where("n = 2").collect()] == [3]
    events = spark.createDataFrame([(1, 1, False, None, False), (1, 2, False, False, False), (1, 1, True, False, False), (1, 1, False, False, True)], "start int, end int, read_only boolean, disabled boolean, is_composing boolean")
    assert editor.ready(events).count() == 1


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "kv"))
    log.append(spark.createDataFrame([("a", "k", "1", 1), ("a", "j", "2", 1), ("b", "k", "3", 1)], SCHEMA))
    log.append(spark.createDataFrame([("a", "k", "4", 2), ("a", "j", None, 2)], SCHEMA))
    assert [(r["key"], r["value"]) for r in log.list("a").collect()] == [("k", "4")]
    assert log.get("b", "k").first()["value"] == "3" and log.get("b", "z").first() is None
    log.clear("a", 3)
    assert log.list("a").count() == 0 and log.list("b").count() == 1


EVENTS = [
    ("s", 0, "schedule", None, 20, None, None), ("s", 100, "schedule", None, 20, None, None), ("s", 420, "response", 2, None, "hello", None), ("s", 440, "accept", None, None, None, None),
    ("s", 500, "schedule", None, 20, None, None), ("s", 900, "schedule", None, 20, None, None), ("s", 950, "response", 3, None, "late", None), ("s", 1300, "response", 4, None, "x", None),
    ("s", 1305, "dismiss", None, None, None, "escape"), ("s", 1400, "schedule", None, 3, None, None), ("t", 0, "schedule", None, 20, None, None), ("t", 9000, "cancel", None, None, None, None),
]
EXPECTED = [
    ("s", 0, "request_scheduled"), ("s", 100, "request_canceled_before_send"), ("s", 100, "request_scheduled"), ("s", 420, "provider_latency"), ("s", 420, "ghost_shown"), ("s", 440, "ghost_accepted"),
    ("s", 500, "request_scheduled"), ("s", 900, "request_aborted_in_flight"), ("s", 900, "request_scheduled"), ("s", 950, "stale_response_dropped"), ("s", 1300, "provider_latency"), ("s", 1300, "ghost_shown"),
    ("s", 1305, "ghost_dismissed_by_escape"), ("t", 0, "request_scheduled"), ("t", 2800, "provider_error"),
]


#: A short context ends what went before; so does a dismissal while nothing is shown; a ghost that typing finds is dismissed by it.
ENDINGS = [
    ("a", 0, "schedule", None, 20, None, None), ("a", 100, "schedule", None, 11, None, None), ("b", 0, "schedule", None, 12, None, None), ("b", 400, "schedule", None, 0, None, None), ("b", 450, "response", 1, None, "x", None),
    ("c", 0, "schedule", None, 20, None, None), ("c", 200, "dismiss", None, None, None, "escape"), ("d", 0, "schedule", None, 20, None, None), ("d", 350, "dismiss", None, None, None, "blur"), ("d", 500, "response", 1, None, "x", None),
    ("e", 0, "schedule", None, 20, None, None), ("e", 400, "response", 1, None, "x", None), ("e", 500, "schedule", None, 3, None, None), ("e", 510, "accept", None, None, None, None),
    ("f", 0, "schedule", None, 20, None, None), ("f", 400, "response", 1, None, "x", None), ("f", 500, "cancel", None, None, None, None), ("f", 510, "dismiss", None, None, None, "escape"),
    ("g", 0, "schedule", None, 20, None, None), ("g", 400, "response", 1, None, "x", None), ("g", 500, "dismiss", None, None, None, "blur"), ("g", 600, "schedule", None, 20, None, None),
]
ENDED = [
    ("a", 0, "request_scheduled"), ("a", 100, "request_canceled_before_send"), ("b", 0, "request_scheduled"), ("b", 400, "request_aborted_in_flight"), ("b", 450, "stale_response_dropped"),
    ("c", 0, "request_scheduled"), ("c", 200, "request_canceled_before_send"), ("d", 0, "request_scheduled"), ("d", 350, "request_aborted_in_flight"), ("d", 500, "stale_response_dropped"),
    ("e", 0, "request_scheduled"), ("e", 400, "provider_latency"), ("e", 400, "ghost_shown"), ("e", 500, "ghost_dismissed_by_typing"), ("f", 0, "request_scheduled"), ("f", 400, "provider_latency"), ("f", 400, "ghost_shown"),
    ("g", 0, "request_scheduled"), ("g", 400, "provider_latency"), ("g", 400, "ghost_shown"), ("g", 500, "ghost_dismissed_by_blur"), ("g", 600, "request_scheduled"), ("g", 3400, "provider_error"),
]


@pytest.mark.parametrize(("events", "expected"), [(EVENTS, EXPECTED), (ENDINGS, ENDED)])
def test_lives_of_requests(spark, events, expected):
    rows = [(*e[:2], k, *e[2:]) for k, e in enumerate(events)]
    events = spark.createDataFrame(rows, "session string, at_ms long, seq int, type string, request int, context_length int, text string, reason string")
    found = requests.metric_rows(requests.lives(events)).select("session", "at_ms", "type").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
