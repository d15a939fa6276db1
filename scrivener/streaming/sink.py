"""A bounded log of metric events, written by micro-batches that may run twice.

Under the log's folder each finished batch leaves one table: the newest ``n`` rows of every
key after it.  A batch starts from the table of the batch before it, whatever later ones
there are, and replaces its own, so running it again changes nothing.  A reader takes the
last table that was finished; older ones go once two newer are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import last_n


class BoundedLog:
    def __init__(self, spark: SparkSession, path: str, n: int, *by: str, order: tuple[str, ...]):
        self.spark, self.path, self.n, self.by, self.order = spark, path.rstrip("/"), n, by, order

    def finished(self) -> list[int]:
        """Batches whose table is whole, in order."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = store.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName().removeprefix("batch-")) for s in done or [])

    def drop(self, batch: int) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{batch}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def read(self) -> DataFrame | None:
        """The log as of the last finished batch; None before the first."""
        done = self.finished()
        return self.spark.read.parquet(f"{self.path}/batch-{done[-1]}") if done else None

    def add(self, events: DataFrame, batch: int) -> None:
        """Takes one batch in; for ``foreachBatch``."""
        earlier = [b for b in self.finished() if b < batch]
        rows = events
        if earlier:
            rows = self.spark.read.parquet(f"{self.path}/batch-{earlier[-1]}").unionByName(events)
        last_n(rows, self.n, *self.by, order=self.order).drop("place").write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        for old in earlier[:-1]:
            self.drop(old)

    def writer(self) -> Callable[[DataFrame, int], None]:
        return lambda events, batch: self.add(events, batch)
