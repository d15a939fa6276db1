"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items give windows of ten consecutive words (a shorter item is one
window).  Text and windows are normalised to words with one space around each,
so that an occurrence of a window is an occurrence of its bytes, spaces included.
A searcher keeps, for the blocks of ``BLOCK`` bytes in the first ``m`` bytes of
its patterns (``m``: the shortest pattern's length), how far the search may shift;
where it may not shift, the block's bucket holds the candidate patterns by their
first bytes, and comparison confirms.  Patterns are grouped by length, so a
short item does not shorten the shifts for all others.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, held, staged

WINDOW = 10
BLOCK = 8
#: Bytes of benchmark text whose tables one pass over the documents may hold; a larger benchmark takes more passes.
PASS_BYTES = 8_000_000
#: A-Z to a-z; ASCII other than letters and digits to spaces; other bytes stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Searcher:
    """Wu-Manber tables for patterns of similar length."""

    def __init__(self, patterns: dict[bytes, set[int]]):
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, self.m + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.bucket[pattern[self.m - self.block : self.m]][pattern[: self.m]].append((pattern, items))
        self.bucket = {suffix: dict(heads) for suffix, heads in self.bucket.items()}

    def find(self, text: bytes) -> Iterator[tuple[int, int, set[int]]]:
        """Start, end and items of every occurrence of every pattern."""
        m, block, far, shift, bucket = self.m, self.block, self.far, self.shift.get, self.bucket
        at, n = m, len(text)
        while at <= n:
            ends = text[at - block : at]
            skip = shift(ends, far)
            if skip:
                at += skip
                continue
            start = at - m
            for pattern, items in bucket[ends].get(text[start:at], ()):
                if text.startswith(pattern, start):
                    yield start, start + len(pattern), items
            at += 1


def searchers(items: list[tuple[str, bytes]]) -> list[Searcher]:
    """Tables for (item_id, text) rows, by the windows' lengths in powers of two."""
    by_size: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - WINDOW + 1)) if w else ():
            pattern = b" " + b" ".join(w[k : k + WINDOW]) + b" "
            by_size[len(pattern).bit_length()][pattern].add(item)
    return [Searcher(dict(group)) for group in by_size.values()]


def search(text: bytes | None, tables: list[Searcher]) -> tuple[int, list[tuple[int, int]], set]:
    """Words of a text, the merged word ranges that occurrences cover, and the items that occur."""
    flat = b" ".join([b"", *words(text), b""])
    n = max(0, flat.count(b" ") - 1)
    hits, items = [], set()
    for table in tables:
        for a, b, found in table.find(flat):
            hits.append((a, b))
            items |= found
    ranges: list[list[int]] = []
    at = word = 0
    for a, b in sorted(hits):
        word += flat.count(b" ", at, a)
        at = a
        end = word + flat.count(b" ", a, b) - 1
        if ranges and word <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([word, end])
    return n, [tuple(r) for r in ranges], items


def occurrences(docs: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
    """Adds n_words, ranges (merged [first, end) word ranges) and item_ids to ``docs`` for some items.

    ``docs`` has a column ``text``; other columns pass through.
    """
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most PASS_BYTES of text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held(key, lambda: searchers(shared.value))
        for batch in batches:
            n, ranges, found = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                k, r, i = search(text, tables)
                n.append(k)
                ranges.append([{"first": a, "end": b} for a, b in r])
                found.append(sorted(i))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "ranges", "item_ids"])

    schema = docs.schema
    return docs.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + (", " if len(schema) else "") + "n_words long, ranges array<struct<first:long,end:long>>, item_ids array<string>")


def passes(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in groups of about PASS_BYTES; the caller holds one, or two while it asks whether there is another."""
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // PASS_BYTES) or 1
    if groups > 1:  # written once by group, so that no pass reads the others' texts
        by = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int")
        known = staged(known.withColumn("pass", by).repartition("pass").sortWithinPartitions("pass"), "benchmark")
    for k in range(groups):
        yield [tuple(r) for r in (known.where(F.col("pass") == k).select("item_id", "text") if groups > 1 else known).collect()]


def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (any columns, a string column ``text``) in which no window occurs; between two passes they are written."""
    columns, written = docs.columns, None
    for k, items in enumerate(passes(benchmark)):
        if k:
            docs, before = staged(docs, "clean"), written
            written = docs
            if before is not None:
                drop_staged(before)
        docs = occurrences(docs, items).where(F.size("ranges") == 0).select(*columns)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Word counts and benchmark hits of every row of ``docs`` (doc_id, text).

    doc_id, n_words, n_hit (words inside any occurrence of a window), item_ids
    (items with occurring windows, sorted as strings), ranges (merged word ranges
    that are hit).  A null or wordless text has no words and no hit; items without
    words have no window; rows that repeat are answered each on its own.  An
    item_id or text that is null takes no part.  Of a benchmark of more than one pass,
    each writes its hits alone, and they are merged by a row number.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = passes(benchmark)
    first, second = next(groups), next(groups, None)
    if second is None:
        return counted(occurrences(plain, first))

    rows = staged(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    every = staged(occurrences(rows, first).drop("text"), "hits")
    while second is not None:
        every = every.unionByName(staged(occurrences(rows, second).drop("text").where(F.size("ranges") > 0), "hits"))
        second = next(groups, None)
    drop_staged(rows)
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("every"))
    empty = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")
    joined = F.aggregate(
        "every",
        empty,
        lambda done, r: F.when((F.size(done) > 0) & (r["first"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end"))))).otherwise(F.concat(done, F.array(r))),
    )
    return counted(merged.withColumn("ranges", joined))


def counted(found: DataFrame) -> DataFrame:
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", "ranges")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from those of :func:`decontaminate`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
