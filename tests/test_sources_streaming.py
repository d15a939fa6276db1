from __future__ import annotations

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from scrivener.functions import completion
from scrivener.operators import metrics
from scrivener.sources import blob, provider, vocabulary
from scrivener.streaming import keystrokes

ENTRIES = [("abb", 10, 0), ("abc", 100, 1), ("zebra", 4_294_967_295, 0)]


def test_blob_round_trip():
    data = blob.encode(ENTRIES)
    assert blob.decode(data, strict=True) == ("en-US", [(k, *e) for k, e in enumerate(ENTRIES)])
    assert blob.decode(blob.encode([])) == ("en-US", [])


@pytest.mark.parametrize(
    ("change", "code"),
    [(lambda b: b[:10], blob.INVALID_INPUT), (lambda b: b"X" + b[1:], blob.BAD_MAGIC), (lambda b: b[:8] + b"\2" + b[9:], blob.BAD_VERSION), (lambda b: b[:14] + b"\1" + b[15:], blob.OUT_OF_BOUNDS), (lambda b: b[:-1], blob.OUT_OF_BOUNDS)],
)
def test_faulty_blobs(change, code):
    with pytest.raises(blob.DictionaryError) as fault:
        blob.decode(change(blob.encode(ENTRIES)), strict=True)
    assert fault.value.code == code


def test_strict_limits():
    for entries, code in (([], blob.EMPTY), ([("it's", 0, 0)], blob.OUT_OF_BOUNDS), ([("\u00e9", 0, 0)], blob.OUT_OF_BOUNDS)):
        data = blob.encode(entries)
        assert len(blob.decode(data)[1]) == len(entries)
        with pytest.raises(blob.DictionaryError) as fault:
            blob.decode(data, strict=True)
        assert fault.value.code == code
    for bad in ([("", 0, 0)], [("A", 0, 0)], [("a", 0, 0), ("a", 1, 0)], [("a", -1, 0)], [("a", 2**32, 0)]):
        with pytest.raises(blob.DictionaryError):
            blob.encode(bad)


def test_data_source(spark, tmp_path):
    blob.register(spark)
    path = str(tmp_path / "words.bin")
    words = spark.createDataFrame([(k, *e) for k, e in enumerate(ENTRIES)], vocabulary.SCHEMA)
    words.coalesce(1).write.format("dictionary").mode("append").save(path)
    assert spark.read.format("dictionary").option("mode", "strict").load(path).collect() == words.collect()
    (tmp_path / "bad.bin").write_bytes(b"nonsense")
    found = blob.decoded(spark.read.format("binaryFile").load(f"{tmp_path}/*.bin")).collect()
    assert {r["code"] for r in found} == {0, blob.INVALID_INPUT} and len(found) == 4
    packed = blob.blobs(words.withColumn("name", F.lit("w"))).first()
    assert bytes(packed["content"]) == blob.encode(ENTRIES)


def test_providers(spark):
    def answer(request):
        if request == "slow":
            raise TimeoutError
        return {"ok": '{"text": " more words", "model": "m"}', "odd": '{"text": 5}', "bad": "{"}[request]

    asked = spark.createDataFrame([(r, "some") for r in ("ok", "slow", "odd", "bad")], "request string, context_before string")
    found = {r["request"]: r for r in provider.shown(provider.completed(asked, answer)).collect()}
    assert found["ok"]["text"] == " more words" and found["ok"]["error"] is None
    assert {k: found[k]["error"] for k in ("slow", "odd", "bad")} == {"slow": "timeout", "odd": "malformed_response", "bad": "malformed_response"}


def test_keystrokes(spark, tmp_path):
    rows = [("s", 1, "teh ", 4, False), ("s", 2, "teh x", 5, False), ("s", 3, "teh ", 4, True), ("s", 4, "see /etc/x ", 11, False), ("s", 5, "the,", 4, False)]
    snapshots = spark.createDataFrame(rows, "session string, at long, text string, caret int, is_composing boolean")
    snapshots.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(snapshots.schema).parquet(str(tmp_path / "in"))
    table = keystrokes.autocorrect_table(spark)
    q = keystrokes.decided(stream, table).writeStream.format("memory").queryName("typed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    assert sorted((r["at"], r["token"], r["action"], r["replacement"]) for r in spark.table("typed").collect()) == [(1, "teh", "auto_correct", "the"), (5, "the", "do_nothing", None)]
    assert {r["token"]: r["action"] for r in keystrokes.decide_batch(snapshots).collect()} == {"teh": "auto_correct", "the": "do_nothing"}


def test_latency_summary_of_nothing(spark):
    empty = spark.createDataFrame([(float("nan"),), (-1.0,), (None,)], "ms double")
    assert tuple(metrics.latency_summary(empty, "ms").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    some = spark.createDataFrame([(float(x),) for x in range(1, 11)], "ms double")
    assert tuple(metrics.latency_summary(some, "ms").first()) == (10, 5.5, 5.0, 10.0, 10.0, 10.0)


def test_request_timings(spark):
    events = spark.createDataFrame([(1, "request_scheduled", 0), (1, "request_sent", 10), (1, "response_received", 35), (1, "ghost_shown", 35), (1, "ghost_accepted", 55), (2, "request_scheduled", 5)], "request_id long, type string, at_ms long")
    assert sorted(map(tuple, metrics.request_timings(events).collect()), key=lambda r: r[0]) == [(1, 10, 25, 35, 20), (2, None, None, None, None)]


def test_dictionary_sources_in_order(spark, tmp_path):
    content = blob.encode([("abc", 1, 0)])
    assert blob.decoded(blob.source(spark, content, load=lambda: b"x", path="/none"), strict=True).first()["word"] == "abc"
    assert blob.decoded(blob.source(spark, load=lambda: content, path="/none"), strict=True).first()["word"] == "abc"
    (tmp_path / "d.bin").write_bytes(content)
    assert blob.decoded(blob.source(spark, path=str(tmp_path / "d.bin")), strict=True).first()["word"] == "abc"
    with pytest.raises(blob.DictionaryError, match="must give"):
        blob.source(spark)
    with pytest.raises(blob.DictionaryError, match="DICTIONARY_INVALID_MAGIC") as fault:
        blob.source(spark, b"y" * 40)
    assert fault.value.code == blob.BAD_MAGIC


def test_a_dictionary_is_written_from_one_partition(spark, tmp_path):
    blob.register(spark)
    words = spark.createDataFrame([(k, w, 1, 0) for k, w in enumerate(("ab", "cd", "ef", "gh"))], blob.SCHEMA)
    path = str(tmp_path / "d.bin")
    with pytest.raises(Exception, match="coalesce"):
        words.repartition(2).write.format("dictionary").mode("append").option("path", path).save()
    assert list(tmp_path.iterdir()) == []
    words.coalesce(1).write.format("dictionary").mode("append").option("path", path).save()
    assert [r["word"] for r in spark.read.format("dictionary").option("path", path).load().collect()] == ["ab", "cd", "ef", "gh"]


def test_a_folder_of_dictionaries_has_a_partition_for_each_file(spark, tmp_path):
    blob.register(spark)
    for name, words in (("a.bin", ["ab", "cd"]), ("b.bin", ["ef"]), ("c.bin", [])):
        if words:
            rows = spark.createDataFrame([(k, w, 1, 0) for k, w in enumerate(words)], blob.SCHEMA).coalesce(1)
            rows.write.format("dictionary").mode("append").option("path", str(tmp_path / name)).save()
        else:
            (tmp_path / name).write_bytes(blob.encode([]))
    found = spark.read.format("dictionary").option("path", str(tmp_path)).load()
    assert sorted(r["word"] for r in found.collect()) == ["ab", "cd", "ef"] and found.rdd.getNumPartitions() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "b.bin", "c.bin"]
    many = spark.range(blob.WORDS + 1).selectExpr("cast(id as int) load_order", "concat('w', id) word", "cast(1 as bigint) frequency", "cast(0 as bigint) flags")
    with pytest.raises(Exception, match="more than"):
        many.coalesce(1).write.format("dictionary").mode("append").option("path", str(tmp_path / "d.bin")).save()


def test_failures_of_providers(spark):
    def answer(request):
        raise {"http": provider.HttpError("503"), "stop": InterruptedError(), "net": ConnectionError(), "odd": KeyError()}[request]

    asked = spark.createDataFrame([(r,) for r in ("http", "stop", "net", "odd")], "request string")
    assert {r["request"]: r["error"] for r in provider.completed(asked, answer).collect()} == {"http": "http", "stop": "aborted", "net": "network", "odd": "provider"}


def test_an_endpoint_answers_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["content-length"])))["request"]
            if asked["mode"] == "slow":
                time.sleep(3)
            self.send_response(503 if asked["mode"] == "down" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"text": f" for {asked['mode']} {self.headers.get('x-key')} {self.headers.get('x-none')}"}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        answer = provider.Endpoint(f"http://127.0.0.1:{server.server_port}/", lambda: {"x-key": "k", "x-none": None}, timeout=1)
        texts = spark.createDataFrame([(m, "some text", 4) for m in ("inline", "down", "slow")], "mode string, text string, caret int")
        context = completion.context(F.col("text"), F.col("caret"))
        asked = texts.select(completion.request(F.lit("completion-1"), F.col("mode"), context).alias("request"), F.lit("some").alias("context_before"))
        found = {json.loads(r["request"])["mode"]: (r["text"], r["error"]) for r in provider.shown(provider.completed(asked, answer)).collect()}
        assert found["inline"] == (" for inline k None", None) and found["down"][1] == "http" and found["slow"][1] == "timeout"
        assert provider.completed(asked, provider.Endpoint("http://127.0.0.1:9/", timeout=1)).first()["error"] == "network"
    finally:
        server.shutdown()
