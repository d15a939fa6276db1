"""Helpers shared by the operators of this subpackage.

Lineage is cut by writing Parquet to the folder every executor shares: the one
the cluster names in ``spark.checkpoint.dir``.  Only where that is unset (tests
on one machine) does :func:`shared_dir` choose a folder itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, read from the session.

    Where none is set, a session on one machine gets a folder of its own; a cluster's
    executors would each write to their own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scrivener-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str, lasting: bool = False) -> str:
    """A new path in the shared folder; a ``lasting`` one outlives :func:`tidied`."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _open.get() is not None and not lasting:
        _open.get().append((spark, path))
    return path


#: Paths handed out inside :func:`tidied`, or None outside of it.
_open: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("open", default=None)


@contextmanager
def tidied() -> Iterator[None]:
    """Removes at its end, however it ends, the intermediate tables written inside it.

    Operators return before their last tables are read, so the caller who writes an
    operator's result says when they can go.
    """
    token = _open.set([])
    try:
        yield
    finally:
        for spark, path in _open.get():
            drop_path(spark, path)
        _open.reset(token)


def staged(df: DataFrame, what: str = "stage") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def drop_staged(df: DataFrame) -> None:
    """Removes the table of a frame that :func:`staged` gave; nothing may read it again."""
    drop_path(df.sparkSession, df.staged_path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that no later job reads."""
    store, where = file_system(spark, path)
    store.delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    store, where = file_system(spark, path)
    return store.exists(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """The text, and every other column in one called ``row``, so that no operator's column can clash and no text is carried twice."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns named ``columns`` again from what :func:`packed` made of them."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def ascii_lower(col: Column | str) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no classifier may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than it must."""
    return df.limit(rows + 1).count() <= rows


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in a Python worker while its tasks ask for the same ``key``.

    Workers outlive operators, so they keep one thing: the tables of one operator
    leave before those of the next are made.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
