from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.functions import units
from scrivener.operators import editor
from scrivener.sources.storage import SCHEMA, ChangeLog


def test_offsets_in_utf16_units(spark):
    texts = ["", "abc", "\U0001f600", "a\U0001f600b\U0001d11e\U0001d11ec", "é中\U0001f600", "￿\U00010000x"]
    rows = [(k, t, n) for k, t in enumerate(texts) for n in range(len(t) + 1)]
    df = spark.createDataFrame(rows, "k int, text string, n int")
    size = lambda s: len(s.encode("utf-16-le")) // 2
    found = {(r["k"], r["n"]): (r["m"], r["size"]) for r in units.in_units(df.withColumn("m", F.col("n")), "m").withColumn("size", units.length(F.col("text"))).collect()}
    assert found == {(k, n): (size(t[:n]), size(t)) for k, t, n in rows}
    every = [(k, t, n) for k, t in enumerate(texts) for n in range(size(t) + 1)]
    back = units.in_points(spark.createDataFrame(every, "k int, text string, n int").withColumn("m", F.col("n")), "m")
    assert {(r["k"], r["n"]): r["m"] for r in back.collect()} == {(k, n): max(i for i in range(len(t) + 1) if size(t[:i]) <= n) for k, t, n in every}


def test_selections_that_are_no_news(spark):
    rows = [(1, "selection", 1, 0, 0), (2, "selection", 1, 0, 0), (3, "selection", 1, 0, 2), (4, "blur", 1, 9, 9), (5, "selection", 1, 0, 2), (6, "input", 2, 3, 3), (7, "selection", 2, 3, 3), (8, "selection", 1, 3, 3), (9, "input", 2, 1, 2)]
    df = spark.createDataFrame([("s", *r, False) for r in rows] + [("t", 1, "input", 1, 1, 1, True), ("t", 2, "selection", 1, 1, 1, None)], "session string, seq int, type string, version int, start int, end int, composing boolean")
    found = [(r["session"], r["seq"], r["reason"]) for r in editor.selection_dismissals(df, "session", "seq").orderBy("session", "seq").collect()]
    change = "selection_change"
    assert found == [("s", 1, change), ("s", 3, change), ("s", 4, "blur"), ("s", 8, change), ("s", 9, change), ("t", 1, "composition")]


def living(log):
    return sorted((r["namespace"], r["key"], r["value"]) for n in ("a", "b") for r in log.list(n).collect())


def test_compaction_changes_no_value(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "kv"))
    assert living(log) == [] and log.compact() == 1 and living(log) == []
    log.append(spark.createDataFrame([("a", "k", "1", 1), ("a", "j", "2", 1), ("b", "k", "3", 1)], SCHEMA))
    log.append(spark.createDataFrame([("a", "k", "4", 2), ("a", "j", None, 2)], SCHEMA))
    before = living(log)
    assert before == [("a", "k", "4"), ("b", "k", "3")]
    assert log.compact() == 2 and living(log) == before
    log.append(spark.createDataFrame([("a", "j", "late", 1), ("b", "n", "5", 3)], SCHEMA))  # the first is older than the deletion
    after = before + [("b", "n", "5")]
    assert living(log) == after
    log.vacuum()
    assert living(log) == after and log.snapshots() == [2]
    assert log.compact(keep_deletions_since=3) == 3 and living(log) == after
    log.vacuum()
    assert log.log().count() == 3 and len(log._names("log/namespace=*/*.parquet")) == 0  # what is read does not grow with the history
    assert log.get("b", "n").first()["value"] == "5"


def test_an_unfinished_snapshot_does_not_count(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "kv"))
    log.append(spark.createDataFrame([("a", "k", "1", 1)], SCHEMA))
    log.compact()
    log.append(spark.createDataFrame([("a", "k", "2", 2)], SCHEMA))
    number = log.compact()
    store, marker = log._at(f"{log.path}/snapshots/done-{number}")
    store.delete(marker, False)
    assert living(log) == [("a", "k", "2")]  # from the former snapshot and the files since
