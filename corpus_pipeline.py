"""The training-data pipeline over ``documents``: five stages, each one operator of ``scrivener.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents that stay, with
all their columns; the last returns what the token store holds.  ``run`` writes each
stage's rows as Parquet in the shared folder, reads them again, and removes them when the
next stage has written its own; what stays is the token store.

Common cases: a null text has no letter, so the first stage rejects it; an empty
table stays empty through all stages; every row is judged on its own, so rows that
share a doc_id, or have none, stay or go each by its text, and of equal rows
near-dedup keeps one; columns of any other name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import decontaminate, langid, mixing, simhash, token_store
from scrivener.llm.common import drop_path, fresh_path, held_out, packed, table, tidied, unpacked

#: Posterior of the best language that a document needs.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, or with no clear language, go."""
    trees = langid.learn(docs.where(~held_out("doc_id")))
    found = langid.predict(packed(docs), trees)
    return unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id, of several the first in the table."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return unpacked(decontaminate.without_hits(packed(docs), table(spark, sf_dir, "benchmark")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the label domains to their target shares."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token store."""
    return token_store.token_store(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_neardup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix_sources),
    ("token store", token_output),
]

#: Byte contexts, fingerprints and fitted rates are beyond SQL; a brute-force test stands in for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with tidied():  # what a stage writes on its way goes when its rows are written
            made = stage(spark, docs, sf_dir)
            path = fresh_path(spark, "corpus", lasting=True)
            made.write.parquet(path)
        if former is not None:
            drop_path(spark, former)
        docs, former = spark.read.schema(made.schema).parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads the store alone
    drop_path(spark, former)
    return out
