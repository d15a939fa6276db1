"""Substring dedup by sliding sentence spans.

A text is cut into sentences and their parts between commas (all called sentences
here).  From each sentence on, and back from each, the shortest run of at least
``SENTENCES`` sentences and ``WORDS`` words is hashed: a longer run that repeats is
covered by such runs, all of which repeat with it.  Runs of all rows meet by
hash; one that occurs again keeps its first place, and the sentences of every
later one are covered, and removed.  Covered sentences that follow each other make a stretch.

A row is told by its doc_id; rows whose doc_id is null or stands more than once are
written first with a number of their own.  The first place is the smallest by doc_id
(null last), number and position.

Two passes keep the shuffles small.  The first counts 64-bit hashes; the second
shuffles the places of all runs to those that repeat, and 96 bits settle which are
equal.  Joins are by sorted shuffles at every size: what repeats has no bound.  The text
itself is shuffled only to give back the shortened documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, small_enough, staged

SENTENCES = 2
#: A run with fewer words (a licence line, a common phrase) is no passage.
WORDS = 13
#: Most doc_ids that are broadcast to set apart their rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Stands for a null doc_id, and where the numbers of such rows begin.
NO_ID, NO_ID_COPIES = (1 << 63) - 1, 1 << 62
#: What ends a sentence, as the inside of a character class.
MARKS = r".!?,;:|\n…。！，？"
SENTENCE = re.compile(rf"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+")
#: What is no word within a sentence, and the end of one.
OTHER, ENDS = re.compile(r"[^\w\n]+"), re.compile(rf"[{MARKS}]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, in characters: they tile the text, marks and line ends belong to what stands before them."""
    return [m.span() for m in SENTENCE.finditer(text)]


def normalised(text: str) -> tuple[list[int], list[int], bytes]:
    """Words before each sentence (and in all), where their bytes begin, and the words of the text with a blank after each."""
    lines = OTHER.sub(" ", ENDS.sub("\n", text.lower())).encode("utf-8", "replace").split(b"\n")
    if not lines[-1]:  # nothing after the last mark
        lines.pop()
    parts = [line.strip() + b" " if line.strip() else b"" for line in lines]
    counts = [0, *accumulate(part.count(b" ") for part in parts)]
    return counts, [0, *accumulate(map(len, parts))], b"".join(parts)


def forward(counts: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentences and ends (exclusive) of the shortest runs from each sentence on that are long enough; a run begins and ends with a word."""
    starts = np.flatnonzero(counts[1:] > counts[:-1])
    ends = starts + 1
    k = np.maximum(np.searchsorted(counts[ends], counts[starts] + least_words), np.searchsorted(ends, starts + least_sentences))
    there = k < len(ends)
    return starts[there], ends[k[there]]


def backward(counts: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`forward`, for the shortest runs back from each sentence."""
    starts = np.flatnonzero(counts[1:] > counts[:-1])
    ends = starts + 1
    k = np.minimum(np.searchsorted(counts[starts], counts[ends] - least_words, "right"), np.searchsorted(starts, ends - least_sentences, "right")) - 1
    there = k >= 0
    return starts[k[there]], ends[there]


def runs(text: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """First sentence, end (exclusive) and normalised words of each sentence's shortest run that is long enough."""
    counts, places, words = normalised(text)
    for i, end in zip(*(x.tolist() for x in forward(np.array(counts), least_sentences, least_words))):
        yield i, end, words[places[i] : places[end] - 1]


def all_runs(text: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> list[tuple[int, int, bytes]]:
    """:func:`runs` and, where they differ, the shortest runs back from each sentence."""
    counts, places, words = normalised(text)
    if counts[-1] < least_words:
        return []
    known = np.array(counts)
    (a, b), (c, d) = forward(known, least_sentences, least_words), backward(known, least_sentences, least_words)
    both = np.unique(np.concatenate([a, c]) << 32 | np.concatenate([b, d]))
    return [(i, end, words[places[i] : places[end] - 1]) for i, end in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist())]


def stretches(covered: list[int]) -> list[tuple[int, int]]:
    """First sentence and end (exclusive) of each stretch of covered sentences (ascending)."""
    found: list[list[int]] = []
    for i in covered:
        if found and found[-1][1] == i:
            found[-1][1] = i + 1
        else:
            found.append([i, i + 1])
    return [(a, b) for a, b in found]


def digests(runs_: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each run."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, runs_)), dtype="<i8").reshape(-1, 2)


def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the 64-bit hashes of their runs."""
    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = [w for _, _, w in all_runs(text)]
            if words:
                found = digests(words)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy())], names=["hash"])


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) to a row for each run: its hash, 32 bits of another, and its place."""
    for batch in batches:
        for doc_id, copy, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = all_runs(text)
            if found:
                first, end, words = zip(*found)
                both = digests(words)
                columns = [both[:, 0].copy(), both[:, 1].astype(np.int32), np.full(len(first), doc_id), np.full(len(first), copy), np.array(first, np.int32), np.array(end, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "more", "doc_id", "copy", "first", "end"])


def grouped(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """What ``make`` yields, put together to batches of some size."""
    held, size = [], 0
    for batch in make(batches):
        held.append(batch)
        size += batch.num_rows
        if size >= 50_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def told_apart(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with a text as (doc_id, copy, text): no two have the same doc_id and copy."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    often = staged(plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("id")), "often")
    once = plain.select("doc_id", F.lit(0).cast("long").alias("copy"), "text")
    if often.isEmpty():
        return once
    known = F.broadcast(often) if small_enough(often, BROADCAST_IDS) else often
    is_often = F.col("doc_id").eqNullSafe(F.col("id"))
    number = F.monotonically_increasing_id() + F.when(F.col("doc_id").isNull(), NO_ID_COPIES).otherwise(1)
    more = staged(plain.join(known, is_often, "left_semi").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), number.alias("copy"), "text"), "rows")
    return once.join(known, is_often, "left_anti").unionByName(more)


def repeated(rows: DataFrame) -> DataFrame:
    """Later occurrences of repeated runs in ``rows`` (doc_id, copy, text): doc_id, copy, first, end, and of, the document of the first occurrence."""
    hashes = rows.select("text").mapInArrow(lambda it: grouped(it, hash_rows), "hash long")
    again = staged(hashes.groupBy("hash").agg(F.count("hash").alias("n")).where("n > 1").select("hash"), "hashes")
    found = rows.mapInArrow(lambda it: grouped(it, run_rows), "hash long, more int, doc_id long, copy long, first int, end int")
    found = staged(found.join(again.hint("merge"), "hash"), "runs")
    drop_staged(again)
    place = F.struct("doc_id", "copy", "first")
    heads = found.groupBy("hash", "more").agg(F.min(place).alias("head"), F.count("first").alias("n")).where("n > 1")
    # Written first, so that the join deals both sides anew and Spark can split a run that very many documents share.
    heads = staged(heads.select("hash", "more", "head"), "heads")
    later = found.join(heads.hint("merge"), ["hash", "more"]).where(place > F.col("head"))
    later = staged(later.select("doc_id", "copy", "first", "end", F.when(F.col("head.copy") < NO_ID_COPIES, F.col("head.doc_id")).alias("of")), "later")
    drop_staged(found)
    drop_staged(heads)
    return later


def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, later) to the text without its covered stretches and what was removed."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "text", "n_sentences", "n_removed", "spans", "first_docs"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), span, pa.list_(pa.int64()))
    for batch in batches:
        rows = []
        for doc_id, text, later in zip(*(c.to_pylist() for c in batch.columns)):
            cut = sentences(text)
            gone = stretches(sorted({i for r in later for i in range(r["first"], r["end"])}))
            of = {r["of"] for r in later if r["of"] is not None}
            spans = [(cut[a][0], cut[b - 1][1]) for a, b in gone]
            edges = [0, *(e for s in spans for e in s), len(text)]
            left = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc_id, left, len(cut), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in spans], sorted(of)))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def dedup_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that lose sentences, and only those.

    doc_id, text (what is left), n_sentences, n_removed, spans (character ranges that
    went) and first_docs (documents of the first occurrences, sorted).  Each row is a
    text of its own: rows that share a doc_id come in the order of the table, and of
    equal rows all but one lose what repeats.  Rows with a null doc_id come last.  A null
    text, and texts too short for a run, lose nothing; a run that a text repeats within
    itself stays once, at its first place.  Other columns are ignored; an empty table
    gives no rows.
    """
    rows = told_apart(docs)
    # A row's own runs bound its list.
    drops = repeated(rows).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("first", "end", "of")).alias("later"))
    schema = "doc_id long, text string, n_sentences long, n_removed long, spans array<struct<start:int,end:int>>, first_docs array<long>"
    own = F.when(F.col("copy") < NO_ID_COPIES, F.col("doc_id")).alias("doc_id")
    return rows.join(drops.hint("merge"), ["doc_id", "copy"]).select(own, "text", "later").mapInArrow(shorten, schema)


def digest(found: DataFrame) -> DataFrame:
    """The rows of :func:`dedup_spans` with spans and first documents as strings."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "text", "n_sentences", "n_removed", spans.alias("spans"), F.array_join("first_docs", ",").alias("first_docs"))
