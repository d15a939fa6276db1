from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.operators import snapshots


def longest(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def check(a, b):
    found = snapshots.hunks(a, b)
    at, out, same = 0, "", 0
    for start, end, new_start, new_end in found:
        assert at <= start <= end and new_start == len(out) + start - at and (end > start or new_end > new_start)
        same += start - at
        out += a[at:start] + b[new_start:new_end]
        at = end
    assert out + a[at:] == b and same + len(a) - at == longest(a, b)
    return found


@pytest.mark.parametrize("table", [snapshots.TABLE, 2])
def test_scripts_of_all_short_texts(monkeypatch, table):
    monkeypatch.setattr(snapshots, "TABLE", table)
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)] + ["abcabba", "cbabac", "xaxbxc", "é中\U0001f600a"]
    for a, b in itertools.product(texts, texts):
        check(a, b)


def test_scripts_of_long_texts_are_quick():
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("abcdefgh "), 6000))
    b = a[:3000] + "INSERTED" + a[3010:]
    assert [h[:2] for h in check(a[2900:3100], b[2900:3098])][0][0] >= 100
    assert snapshots.hunks(a * 30, a * 30 + "x") == [(180_000, 180_000, 180_000, 180_001)]
    assert sum(e - s for s, e, *_ in snapshots.hunks(a, b)) <= 10


def survivors(texts, marks):
    """Each mark's last place and when it was lost, by its text: it lives while the range its unchanged neighbours give it holds the same characters untouched."""
    out = {}
    for k, (version, start, end) in marks.items():
        lost = None
        for v in range(version + 1, len(texts)):
            found = snapshots.hunks(texts[v - 1], texts[v])
            if any(s < end and e > start and (e > s or start < s) for s, e, *_ in found):
                lost = v
                break
            shift = [n - e for s, e, _, n in found if e <= start]
            was = texts[v - 1][start:end]
            start, end = start + (shift[-1] if shift else 0), end + (shift[-1] if shift else 0)
            assert texts[v][start:end] == was
        out[k] = (start, end, lost)
    return out


def test_marks_through_snapshots(spark):
    rng = np.random.default_rng(2)
    rows, marks, expected = [], [], {}
    for session in range(25):
        texts = ["".join(rng.choice(list("ab c"), rng.integers(0, 30)))]
        for _ in range(5):
            t, i = texts[-1], int(rng.integers(0, len(texts[-1]) + 1))
            texts.append(t[:i] + "".join(rng.choice(list("abx"), rng.integers(0, 3))) + t[i + int(rng.integers(0, 3)) :])
        rows += [(session, v, t) for v, t in enumerate(texts)]
        own = {}
        for k in range(8):
            version = int(rng.integers(0, 4))
            start = int(rng.integers(0, len(texts[version]) + 1))
            end = min(len(texts[version]), start + 1 + int(rng.integers(0, 4)))
            if start < end:
                own[session * 100 + k] = (version, start, end)
        marks += [(session, v, a, b, k) for k, (v, a, b) in own.items()]
        expected |= survivors(texts, own)
    snaps = spark.createDataFrame(rows, "session int, version int, text string").repartition(3)
    found = snapshots.carried(spark.createDataFrame(marks, "session int, version int, mark_start int, mark_end int, id int"), snapshots.scripts(snaps, "session", "version"), "session", "version")
    assert {r["id"]: (r["mark_start"], r["mark_end"], r["lost_at"]) for r in found.collect()} == expected and len(expected) > 100
    assert any(x[2] for x in expected.values()) and not all(x[2] for x in expected.values())


def test_offsets_under_a_script(spark):
    df = spark.createDataFrame([(k,) for k in range(9)], "k int").withColumn("h", F.expr(f"cast(array(named_struct('start', 2, 'end', 4, 'new_start', 2, 'new_end', 5), named_struct('start', 6, 'end', 6, 'new_start', 7, 'new_end', 8)) as {snapshots.HUNKS})"))
    rows = df.orderBy("k").select(snapshots.at(F.col("k"), F.col("h"), True).alias("a"), snapshots.at(F.col("k"), F.col("h"), False).alias("b")).collect()
    assert [r["a"] for r in rows] == [0, 1, 2, 5, 5, 6, 8, 9, 10] and [r["b"] for r in rows] == [0, 1, 2, 2, 5, 6, 7, 9, 10]
