from __future__ import annotations

import re
from pathlib import Path

import pytest
from test_decontaminate import plain as plain_hits
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as cp
from scrivener.llm import common, langid, mixing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, odd_rows):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(1000 + k, r[1], r[2], r[3], r[4]) for k, r in enumerate(odd_rows)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_each_stage_like_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        after = common.staged(stage(spark, docs, tables))
        kept = [tuple(r) for r in after.collect()]
        assert after.columns == columns and set(kept) <= set(before)
        if stage is cp.language_id:
            trees = langid.learn(docs.where(~common.held_out("doc_id")))
            expected = [r for r in before if (s := trees.score([r[1]])[0])[0] != "und" and s[1] >= cp.LEAST_SCORE]
        elif stage is cp.simhash_neardup:
            groups = plain_components([(r[0], plain_fingerprint(r[1])) for r in before])
            expected = [r for r in before if groups[r[0], plain_fingerprint(r[1])] == r[0]]
        elif stage is cp.decontamination:
            expected = [r for r in before if not plain_hits(r[1], items)[1]]
        else:
            drawn = {r["doc_id"]: r["kept"] for r in mixing.mix_labelled(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
            expected = [r for r in before if drawn[r[0]]]
        assert sorted(kept, key=repr) == sorted(expected, key=repr), name
        docs = after
    out = cp.STAGES[-1][1](spark, docs, tables).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in docs.collect())


def test_run(spark, tables):
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert cp.run(spark, tables).count() > 100
    left = sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)
    assert left == ["token"]  # the store, and no stage's rows


def test_no_documents(spark, tables, tmp_path):
    empty = str(tmp_path)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, empty).collect() == []


def test_stage_names():
    assert len(cp.STAGES) == 5 and all(re.fullmatch(r"[\w -]+", n) for n, _ in cp.STAGES)
