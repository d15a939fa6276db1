from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.operators import locking, metrics
from scrivener.streaming import answers, sessions, sink


def racing(seed, many=12):
    """Events of several sessions: snapshots, and corrections that saw this version or another."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(many):
        state, seq = locking.Session(), 0
        for _ in range(30):
            seq += 1
            if state.text is None or rng.random() < 0.3:
                event = {"session": f"s{s}", "seq": seq, "kind": "snapshot", "text": "".join(rng.choice(list("ab c"), rng.integers(0, 20))), "version": None, "length": None, "start": None, "end": None, "original": None, "replacement": None}
            else:
                a = int(rng.integers(0, len(state.text) + 1))
                b = min(len(state.text), a + int(rng.integers(0, 4)))
                event = {"session": f"s{s}", "seq": seq, "kind": "correction", "text": None, "version": state.version - int(rng.random() < 0.4), "length": len(state.text), "start": a, "end": b, "original": state.text[a:b] if rng.random() < 0.9 else "?", "replacement": "".join(rng.choice(list("xy"), rng.integers(0, 3)))}
            state.take(event)
            rows.append(event)
    return rows


def test_only_the_version_that_was_seen_is_written():
    state = locking.Session()
    snap = lambda t: {"seq": 0, "kind": "snapshot", "text": t}
    fix = lambda seq, version, length, start, end, original, new: {"seq": seq, "kind": "correction", "version": version, "length": length, "start": start, "end": end, "original": original, "replacement": new}
    assert state.take(fix(1, 0, 0, 0, 0, "", "x"))[0][1] == "stale"  # no text yet
    state.take(snap("teh cat"))
    assert state.take(fix(2, 1, 7, 0, 3, "teh", "the")) == [(2, "applied", 2, 0, 3)] and state.text == "the cat"
    assert state.take(fix(3, 1, 7, 4, 7, "cat", "dog"))[0][1] == "stale"
    assert state.take(fix(4, 2, 7, 4, 7, "cat", "mouse")) == [(4, "applied", 3, 4, 9)]
    assert state.take(fix(5, 3, 8, 0, 3, "the", "a"))[0][1] == "stale" and state.take(fix(5, 3, 9, 0, 3, "teh", "a"))[0][1] == "stale"
    assert state.take(snap("the mouse")) == [] and state.version == 3
    assert state.take(snap("So the mice")) == [(4, "lost", 4, None, None)] and state.marks == {2: (3, 6)}


def plain(rows):
    out, states = [], {}
    for e in rows:
        out += [(e["session"], *r) for r in states.setdefault(e["session"], locking.Session()).take(e)]
    return sorted(out, key=str)


def test_locked_table(spark):
    rows = racing(1)
    found = locking.locked(spark.createDataFrame(rows, locking.EVENTS).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)
    assert {r["result"] for r in found} == {"applied", "stale", "lost"}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_locked_stream_goes_on_after_a_restart(spark, rocks, tmp_path):
    rows = racing(2, 5)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part, (a, b) in enumerate(((0, 9), (9, 18), (18, 31))):  # each run of the query takes what has come since the last
        spark.createDataFrame([r for r in rows if a < r["seq"] <= b], locking.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(locking.EVENTS).parquet(source)
        query = sessions.locked(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    found = sorted((tuple(r) for r in spark.read.parquet(out).select("session", "seq", "result", "version", "start", "end").collect()), key=str)
    assert found == plain(rows) == sorted((tuple(r) for r in locking.locked(spark.createDataFrame(rows, locking.EVENTS)).collect()), key=str)


def test_answers_in_streams_like_in_tables(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    asked = [(k, at(10 * k)) for k in range(12)] + [(99, "2024-01-01 02:00:00")]
    got = [(0, 1, at(0)), (1, 1, at(12)), (1, 2, at(15)), (2, 1, at(26)), (3, 1, at(29)), (4, 1, at(40)), (50, 1, at(60)), (6, 1, at(65)), (99, 9, "2024-01-01 02:00:01")]
    folders = [str(tmp_path / n) for n in ("asked", "got")]
    shapes = ["request long, at string", "request long, line int, at string"]
    read = lambda df, name: df.select("request", *[c for c in df.columns if c not in ("request", "at")], F.to_timestamp("at").alias(name))
    tables = [read(spark.createDataFrame(r, s), n) for r, s, n in zip((asked, got), shapes, ("sent_at", "received_at"))]
    expected = sorted(map(str, answers.matched(*tables, "5 seconds").collect()))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for low, high in ((0, 5), (5, 12), (12, 1000)):  # the last rows push the watermarks on
        for folder, rows, shape in zip(folders, (asked, got), shapes):
            spark.createDataFrame([r for r in rows if low <= r[0] < high], shape).coalesce(1).write.mode("append").parquet(folder)
        streams = [read(spark.readStream.schema(s).parquet(f), n) for f, s, n in zip(folders, shapes, ("sent_at", "received_at"))]
        joined = answers.matched(*answers.watermarked(*streams, "1 minute"), "5 seconds")
        query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    found = sorted(map(str, spark.read.parquet(out).select("request", "sent_at", "received_at", "line", "result").collect()))
    assert found == expected and {"answered", "unanswered", "stale"} <= {r.rsplit("'", 2)[1] for r in expected}
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 4  # rows of the last minute only


def test_a_bounded_log_of_batches_that_run_twice(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("ab"[int(rng.integers(0, 2))], k, float(rng.random())) for k in range(200)]
    log = sink.BoundedLog(spark, str(tmp_path / "log"), 7, "key", order=("at",))
    assert log.read() is None
    batch = lambda k: spark.createDataFrame(rows[k * 20 : k * 20 + 20], "key string, at long, x double")
    for k in range(10):
        log.add(batch(k), k)
        if k % 3 == 1:  # after a failure the last batch runs again
            log.add(batch(k), k)
        seen = spark.createDataFrame(rows[: k * 20 + 20], "key string, at long, x double")
        if k % 3:
            expected = metrics.last_n(seen, 7, "key", order=("at",)).drop("place")
            assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, expected.collect()))
    assert len(log.finished()) <= 3


def test_a_stream_into_the_bounded_log(spark, tmp_path):
    source = str(tmp_path / "in")
    log = sink.BoundedLog(spark, str(tmp_path / "log"), 3, "type", order=("at_ms",))
    for part in range(3):
        spark.createDataFrame([(t, part * 10 + k) for t in ("shown", "sent") for k in range(5)], "type string, at_ms long").coalesce(1).write.mode("append").parquet(source)
        query = spark.readStream.schema("type string, at_ms long").parquet(source).writeStream.foreachBatch(log.writer()).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(map(tuple, log.read().collect())) == sorted((t, k) for t in ("shown", "sent") for k in (22, 23, 24))
