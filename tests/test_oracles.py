"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from scrivener import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def rows(df, columns):
    return sorted(map(repr, (tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    found, expected = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    assert rows(found, columns) == rows(expected, columns)


def test_every_query_has_its_sql():
    beyond = {"syntax_tokens", "page_syntax"}  # a parse, which test_markdown.py compares with a plain reader's
    assert registry.QUERIES.keys() - beyond == registry.ORACLES.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
