"""A key-value store as a Parquet change log: every change is a row, the newest of a key counts.

Appends add files to ``log`` and rewrite nothing.  :meth:`ChangeLog.compact` folds the log
into a snapshot with one row for each living key, and deletions that a late, older change
must still meet.  A snapshot is a folder of a number of its own: its ``state``, and ``folded``,
the names of the log files that are in it.  It counts from the moment its marker file is
renamed into place, so a reader sees either the former snapshot and all its files or the new
one and those that came since: the same values before, during and after.  :meth:`ChangeLog.vacuum`
removes what no current reader needs; reading then costs the living keys and what was
appended since.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import latest_values

SCHEMA = "namespace string, key string, value string, updated_at long"


class ChangeLog:
    """Values are JSON text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, pattern: str) -> list[str]:
        store, where = self._at(f"{self.path}/{pattern}")
        return sorted(s.getPath().toString() for s in store.globStatus(where) or [])

    def append(self, changes: DataFrame) -> None:
        """Writes changes (columns of SCHEMA); a null value deletes its key."""
        changes.select("key", "value", "updated_at", "namespace").write.mode("append").partitionBy("namespace").parquet(f"{self.path}/log")

    def snapshots(self) -> list[int]:
        """Numbers of the snapshots that count, in order."""
        return sorted(int(n.rsplit("-", 1)[1]) for n in self._names("snapshots/done-*"))

    def log(self) -> DataFrame:
        """The changes that tell every value: those of the last snapshot and those in files it does not hold."""
        done, files = self.snapshots(), self._names("log/namespace=*/*.parquet")
        state = None
        if done:
            folder = f"{self.path}/snapshots/{done[-1]}"
            folded = {r["name"] for r in self.spark.read.parquet(f"{folder}/folded").collect()}
            files = [f for f in files if f not in folded]
            state = self.spark.read.schema(SCHEMA).parquet(f"{folder}/state").select(*[c.split()[0] for c in SCHEMA.split(", ")])
        fresh = self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/log").parquet(*files) if files else self.spark.createDataFrame([], SCHEMA)
        fresh = fresh.select(*[c.split()[0] for c in SCHEMA.split(", ")])
        return fresh if state is None else state.unionByName(fresh)

    def list(self, namespace: str) -> DataFrame:
        """Living entries of a namespace; only its folders are read."""
        return latest_values(self.log().where(F.col("namespace") == namespace))

    def get(self, namespace: str, key: str) -> DataFrame:
        return latest_values(self.log().where((F.col("namespace") == namespace) & (F.col("key") == key)))

    def clear(self, namespace: str, at: int) -> None:
        """Deletes all entries of a namespace by one more row each."""
        self.append(self.list(namespace).select("namespace", "key", F.lit(None).cast("string").alias("value"), F.lit(at).cast("long").alias("updated_at")))

    def compact(self, keep_deletions_since: int | None = None) -> int:
        """Folds what is there into a new snapshot, and gives its number.

        Deletions are kept (those from ``keep_deletions_since`` on, if given), as a change that is
        appended later may be older than they are.  If two compactions run at once, one of
        them gets the number and the other fails, without harm.
        """
        files, done = self._names("log/namespace=*/*.parquet"), self.snapshots()
        number = (done[-1] if done else 0) + 1
        newest = F.max_by(F.struct("value"), F.struct("updated_at", "value")).alias("newest")
        state = self.log().groupBy("namespace", "key").agg(newest, F.max("updated_at").alias("updated_at")).select("namespace", "key", "newest.value", "updated_at")
        if keep_deletions_since is not None:
            state = state.where(F.col("value").isNotNull() | (F.col("updated_at") >= keep_deletions_since))
        making = f"{self.path}/snapshots/making-{uuid.uuid4().hex}"
        state.write.partitionBy("namespace").parquet(f"{making}/state")
        self.spark.createDataFrame([(f,) for f in files], "name string").write.parquet(f"{making}/folded")
        store, where = self._at(making)
        final = self._at(f"{self.path}/snapshots/{number}")[1]
        if store.exists(final) or not store.rename(where, final):
            store.delete(where, True)
            raise RuntimeError(f"snapshot {number} is being made by another compaction")
        store.createNewFile(self._at(f"{self.path}/snapshots/done-{number}")[1])  # from here on it counts
        return number

    def vacuum(self) -> None:
        """Removes log files that the last snapshot holds, and former snapshots; for when no reader of these is at work."""
        done = self.snapshots()
        if not done:
            return
        for name in [r["name"] for r in self.spark.read.parquet(f"{self.path}/snapshots/{done[-1]}/folded").collect()]:
            store, where = self._at(name)
            store.delete(where, False)
        for old in done[:-1]:
            for name in (f"done-{old}", str(old)):
                store, where = self._at(f"{self.path}/snapshots/{name}")
                store.delete(where, True)
