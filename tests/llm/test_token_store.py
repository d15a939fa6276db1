from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivener.llm import token_store as ts

FORM = ts.StoreFormat()
LIBRARY = Tokenizer.from_file(public_tokenizers.path(FORM.vocabulary))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(text):
    return np.frombuffer(ts.encoder(FORM).text(text), dtype="<u2").tolist()


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n\n b", "foo\n ", "don't we'll", "x\t y", "  a", "a  b", "՘ \U0001f600 café", "<|endoftext|> x", "a<|endoftext|>b", "a <|endoftext|> b <|endoftext|>", "<|endoftext", "a \x1c b", "1 22  333", "a\r\n b"])
def test_units_encode_as_the_whole_text(text):
    assert encoded(text) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,ab1é中  "), st.characters(codec="utf-8")), max_size=60))
def test_any_text_encodes_as_by_the_library(text):
    assert encoded(text) == ids(text)


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    for sizes in ([3], [1, 2, 3], [7, 0, 100, 2048]):
        parts = [rng.bytes(4 * n) for n in sizes]
        after = [sum(map(len, parts[k + 1 :])) for k in range(len(parts))]
        sums = ts.shifted(np.array([zlib.crc32(p) for p in parts], dtype=np.uint64), np.array(after))
        assert int(np.bitwise_xor.reduce(sums)) == zlib.crc32(b"".join(parts))


def test_cuts_move_with_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype("<u2")
    shifted = np.concatenate([rng.integers(0, 50_000, 333).astype("<u2"), body])
    chunks = []
    for stream in (body, shifted):
        (ends,) = ts.cuts(stream, np.array([0, len(stream)]), FORM)
        assert ends[-1] == len(stream) and all(0 < b - a <= FORM.longest for a, b in zip([0, *ends], ends))
        chunks.append({stream[a:b].tobytes() for a, b in zip([0, *ends], ends)})
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])


def test_round_trip(spark, odd_docs, odd_rows, tmp_path):
    ts.write_store(odd_docs, str(tmp_path / "store"))
    found = sorted(ts.read_store(spark, str(tmp_path / "store")).collect(), key=lambda r: r["start"])
    ordered = sorted(odd_rows, key=lambda r: -1 if r[0] is None else r[0])
    at = 0
    for row, doc in zip(found, ordered, strict=True):
        own = [*ids(doc[1]), 0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc[0], at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    chunks = spark.read.parquet(str(tmp_path / "store/objects/kind=chunk"))
    assert chunks.count() == chunks.select("address").distinct().count()


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_store(spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string"), path)
    chunks = spark.read.parquet(f"{path}/objects/kind=chunk")
    rows = [(bytes(r["address"]), bytes(r["ids"]) + b"\x01\x00") for r in chunks.select("address", "ids").collect()]
    changed = spark.createDataFrame(rows, "address binary, ids binary")
    changed.write.mode("overwrite").parquet(f"{path}/objects/kind=chunk")
    with pytest.raises(Exception, match="does not match its address"):
        ts.read_store(spark, path).collect()


def rewritten(spark, path, change):
    """Replaces a table of the store by what ``change`` makes of it."""
    df = spark.read.parquet(path)
    rows = [tuple(r) for r in change(df).collect()]
    spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(path)


DAMAGES = {
    "a root of the manifest": ("manifest", lambda df: df.withColumn("root", F.lit(b"0" * 16))),
    "a count of documents": ("manifest", lambda df: df.withColumn("n_docs", F.col("n_docs") + 1)),
    "a count of tokens": ("manifest", lambda df: df.withColumn("n_tokens", F.col("n_tokens") - 1)),
    "a start": ("manifest", lambda df: df.withColumn("start", F.col("start") + 1)),
    "a lost part of the manifest": ("manifest", lambda df: df.where(F.col("part") != df.agg(F.max("part")).first()[0])),
    "a lost recipe": ("recipes", lambda df: df.where("doc_id <> 7")),
    "lost recipes of a part": ("recipes", lambda df: df.where(F.col("part") != df.agg(F.min("part")).first()[0])),
    "a recipe twice": ("recipes", lambda df: df.union(df.where("doc_id = 7"))),
    "recipes that changed places": ("recipes", lambda df: df.withColumn("doc_id", F.when(F.col("doc_id") == 7, 8).when(F.col("doc_id") == 8, 7).otherwise(F.col("doc_id")))),
    "the root of all": ("root", lambda df: df.select(F.lit(b"1" * 16))),
    "a lost chunk": ("objects/kind=chunk", lambda df: df.where(F.col("address") != df.agg(F.min("address")).first()[0])),
}


@pytest.mark.parametrize("damage", DAMAGES)
def test_lost_and_changed_rows_are_found(spark, tmp_path, damage):
    path = str(tmp_path / "store")
    ts.write_store(spark.createDataFrame([(k, " ".join(f"w{(k * j) % 97}" for j in range(k))) for k in range(40)], "doc_id long, text string"), path)
    assert len(ts.read_store(spark, path).collect()) == 40
    table, change = DAMAGES[damage]
    rewritten(spark, f"{path}/{table}", change)
    with pytest.raises(Exception, match="manifest|recipe|chunk"):
        ts.read_store(spark, path).collect()


def test_empty(no_docs):
    assert ts.token_store(no_docs).collect() == []
