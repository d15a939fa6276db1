"""Phrase collocation mining with pivot partitioning.

Words are counted once by language; those that a frequent phrase can hold get numbers in
order of falling frequency.  A phrase belongs to its rarest word, its pivot (of several
equal ones the first).  So for every place of a word the mapper keeps the words around it
that are more frequent, up to the next that is not: the fragment holds all phrases that
this place owns, each occurrence of a phrase is in one fragment, and what a rarer word
owns is rewritten away.  Fragments travel to their pivot's bucket, equal ones of a block
of words as one with a count, many in one row.  A bucket is mined alone and emits phrases
of its own pivots only, growing a fragment by a word only where the shorter phrases
around the pivot are frequent.  Very frequent pivots are dealt to several buckets by
fragment; their partial counts meet in the sum that follows.

Phrases are strings of four-byte word numbers until the end: parts, extensions and scores
are joins and decimal arithmetic, and only what may be listed is spelt out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, held, small_enough, staged

LONGEST, LEAST, LISTED = 5, 100, 2000
#: Words of the frequency list that are sent to all tasks; a longer list is joined.
VOCABULARY = 500_000
#: Occurrences a bucket is planned for, and words whose fragments are counted together before they travel.
BUCKET, BLOCK = 1 << 20, 1 << 20
#: Languages whose totals are sent to all tasks.
LANGUAGES = 10_000
#: Words that a task counts before it hands them on.
COUNTED = 400_000

#: A-Z in lower case, piece marks to line feeds, tabs to spaces.
UPPER, LOWER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?\x0a\x0b\x0c\x0d"
SIMPLER = bytes.maketrans(UPPER + MARKS + b"\t", LOWER + b"\n" * len(MARKS) + b" ")
RARE, BREAK, EMPTY = -1, -2, -3
REACH = LONGEST - 1


def languages(docs: DataFrame) -> DataFrame:
    """lang ('und' where null) and text as bytes."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, word, n)."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        flat = [(lang, word, n) for lang, own in counts.items() for word, n in own.items() if word]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [()] * 3, (pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(lang, Counter()).update(text.translate(SIMPLER).replace(b"\n", b" ").split(b" "))
        if sum(map(len, counts.values())) > COUNTED:
            yield rows(counts)
            counts = {}
    yield rows(counts)


class Numbers(dict):
    """Word numbers of one language; words off the list are rare."""

    def __init__(self, known):
        super().__init__(known)
        self[b"\n"], self[b""] = BREAK, EMPTY

    def __missing__(self, word: bytes) -> int:
        return RARE


def numbered(batches: Iterator[pa.RecordBatch], lists: dict[str, Numbers]) -> Iterator[np.ndarray]:
    """Blocks of word numbers; texts and pieces end in BREAK."""
    none, block, size = Numbers({}), [], 0
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = (text.translate(SIMPLER) + b"\n").replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(lists.get(lang, none).__getitem__, words), np.int32, len(words))
            block.append(numbers[numbers != EMPTY])
            size += len(block[-1])
            if size >= BLOCK:
                yield np.concatenate(block)
                block, size = [], 0
    if block:
        yield np.concatenate(block)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """As :func:`numbered`, from rows that hold the numbers of a piece."""
    block, size = [], 0
    for batch in batches:
        for numbers in batch.column(0).to_pylist():
            block.append(np.array([*numbers, BREAK], np.int32))
            size += len(block[-1])
            if size >= BLOCK:
                yield np.concatenate(block)
                block, size = [], 0
    if block:
        yield np.concatenate(block)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fragments(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different fragments of a block and how often each occurs.

    A row holds REACH words before the pivot, the pivot, and REACH behind it; -1 where
    the fragment has ended.
    """
    size = len(numbers)
    padded = np.full(size + 2 * REACH, BREAK, np.int32)
    padded[REACH : REACH + size] = numbers
    rows = np.full((size, 2 * REACH + 1), -1, np.int32)
    rows[:, REACH] = numbers
    for side in (-1, 1):
        alive = numbers >= 0
        for k in range(1, REACH + 1):
            near = padded[REACH + side * k : REACH + side * k + size]
            alive = alive & (near >= 0) & ((near < numbers) if side < 0 else (near <= numbers))
            rows[alive, REACH + side * k] = near[alive]
    rows = rows[(rows[:, REACH] >= 0) & ((rows[:, REACH - 1] >= 0) | (rows[:, REACH + 1] >= 0))]
    digest = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        digest = mixed(digest * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(2))
    _, first, group = np.unique(digest, return_index=True, return_inverse=True)
    same = (rows == rows[first[group]]).all(axis=1)  # two fragments of one digest stay apart
    counts = np.bincount(group[same], minlength=len(first))
    return np.concatenate([rows[first], rows[~same]]), np.concatenate([counts, np.ones((~same).sum(), np.int64)])


def shares(pivots: np.ndarray, often: np.ndarray) -> np.ndarray:
    """In how many parts each pivot's fragments are dealt out; ``often``: occurrences of the most frequent words by number."""
    out = np.ones(len(pivots), np.int64)
    known = pivots < len(often)
    out[known] = often[pivots[known]] // BUCKET + 1
    return out


def route(blocks: Iterator[np.ndarray], buckets: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, many fragments as bytes)."""
    for numbers in blocks:
        rows, counts = fragments(numbers)
        parts = shares(rows[:, REACH], often)
        digest = mixed(rows[:, REACH].astype(np.uint64) + np.uint64(1))
        split = parts > 1
        if split.any():
            own = np.zeros(split.sum(), np.uint64)
            for column in rows[split].T:
                own = mixed(own * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(2))
            digest[split] = mixed(digest[split] + own % parts[split].astype(np.uint64))
        bucket = (digest % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        made = []
        for k in np.flatnonzero(np.diff(ends)):
            own = order[ends[k] : ends[k + 1]]
            made.append((int(k), packed(rows[own], counts[own])))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.binary()))], names=["bucket", "fragments"])


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """How many, words on each side, counts, and the words alone, in as few bytes a number as they need."""
    used = rows >= 0
    sides = used[:, :REACH].sum(axis=1) * 16 + used[:, REACH + 1 :].sum(axis=1)
    words = rows[used]
    wide = 4 if len(words) and words.max() >= 1 << 16 else 2
    often = 4 if len(counts) and counts.max() >= 256 else 1
    head = np.array([len(rows), wide, often], "<u4").tobytes()
    return head + sides.astype("u1").tobytes() + counts.astype(f"<u{often}").tobytes() + words.astype(f"<u{wide}").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    many, wide, often = np.frombuffer(data, "<u4", 3).tolist()
    sides = np.frombuffer(data, "u1", many, 12)
    counts = np.frombuffer(data, f"<u{often}", many, 12 + many).astype(np.int64)
    words = np.frombuffer(data, f"<u{wide}", offset=12 + many + often * many)
    at = np.arange(-REACH, REACH + 1)
    used = (at[None, :] >= -(sides // 16).astype(np.int64)[:, None]) & (at[None, :] <= (sides % 16).astype(np.int64)[:, None])
    rows = np.full(used.shape, -1, np.int32)
    rows[used] = words
    return rows, counts


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows' places, their summed counts, and each row's group."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    key, used = rows[:, 0].astype(np.int64), bits
    for column in rows.T[1:]:
        if used + bits > 62:  # numbers of the words so far, which need fewer bits
            _, key = np.unique(key, return_inverse=True)
            used = max(1, int(key.max(initial=0)).bit_length())
        key, used = (key << bits) | column, used + bits
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return first, np.bincount(group, weights=counts, minlength=len(first)).astype(np.int64), group


def mine(rows: np.ndarray, counts: np.ndarray, whole: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of each length with their counts: those of ``least`` or more, or all of pivots that are not ``whole`` here."""
    frequent = {(0, 0): np.ones(len(rows), bool)}
    for size in range(2, LONGEST + 1):
        grown, found, weights, origin = {}, [], [], []
        for before in range(size):
            behind = size - 1 - before
            alive = np.ones(len(rows), bool)
            for shorter in ((before - 1, behind), (before, behind - 1)):
                if min(shorter) >= 0:
                    alive &= frequent[shorter]
            if before:
                alive &= rows[:, REACH - before] >= 0
            if behind:
                alive &= rows[:, REACH + behind] >= 0
            grown[before, behind] = np.flatnonzero(alive)
            found.append(rows[grown[before, behind], REACH - before : REACH + behind + 1])
            weights.append(counts[grown[before, behind]])
            origin.append(whole[grown[before, behind]])
        phrases, complete = np.concatenate(found), np.concatenate(origin)
        first, n, group = summed(phrases, np.concatenate(weights))
        good = (n >= least) | ~complete[first]
        frequent, at = {}, 0
        for key, places in grown.items():
            frequent[key] = np.zeros(len(rows), bool)
            frequent[key][places] = good[group[at : at + len(places)]]
            at += len(places)
        yield phrases[first[good]], n[good]


def mine_bucket(table: pa.Table, often: np.ndarray, least: int) -> pa.Table:
    """Rows (bucket, fragments) of one bucket to (phrase, n)."""
    parts = [unpacked(x) for x in table.column("fragments").to_pylist()]
    rows, counts = np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])
    first, counts, _ = summed(rows + 1, counts)
    rows = rows[first]
    out = []
    for phrases, n in mine(rows, counts, shares(rows[:, REACH], often) == 1, least):
        wide = phrases.shape[1] * 4
        data = pa.py_buffer(phrases.astype(">u4").tobytes())
        keys = pa.Array.from_buffers(pa.binary(wide), len(phrases), [None, data])
        out.append(pa.table({"phrase": keys.cast(pa.binary()), "n": pa.array(n)}))
    return pa.concat_tables(out)


def word_numbers(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f, number: words that occur ``least`` times, the most frequent first."""
    listed = words.where(F.col("f") >= least)
    order = (F.col("f").desc(), "lang", "word")
    ranged = staged(listed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "words")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    return ranged.join(F.broadcast(before), "part").select("lang", "word", "f", (F.col("before") + F.col("at")).cast("int").alias("number"))


def by_join(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Word numbers by piece where the list is too long to be sent to all tasks: words meet their numbers in a shuffle."""
    lower = ascii_lower(F.col("text").cast("string"))
    pieces = docs.select("lang", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece", "words"))
    words = pieces.select("lang", "row", "piece", F.posexplode(F.regexp_extract_all("words", F.lit(r"[^\x20\x09]+"), F.lit(0))).alias("at", "word"))
    met = words.withColumn("word", F.col("word").cast("binary")).join(numbers.select("lang", "word", "number"), ["lang", "word"], "left")
    listed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("number", F.lit(RARE)).alias("number"))))
    return met.groupBy("row", "piece").agg(listed.alias("listed")).select("listed.number")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrase, f) of all phrases of up to LONGEST words that occur ``least`` times, single words included; word numbers; (lang, n)."""
    spark = docs.sparkSession
    docs = languages(docs)
    counted = docs.mapInArrow(count_words, "lang string, word binary, n long")
    words = staged(counted.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    numbers = staged(word_numbers(words, least), "numbers")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    occurrences = words.agg(F.sum("f")).first()[0] or 0
    # Words that need several buckets are fewer than all occurrences / BUCKET, and come first.
    often = np.array([r["f"] for r in numbers.where(F.col("f") >= BUCKET).orderBy("number").collect()], np.int64)
    buckets = int(occurrences // BUCKET + 1)
    shape = "bucket int, fragments binary"
    if small_enough(numbers, VOCABULARY):
        lists: dict[str, list] = {}
        for r in numbers.collect():
            lists.setdefault(r["lang"], []).append((bytes(r["word"]), r["number"]))
        shared, key = spark.sparkContext.broadcast(lists), numbers.staged_path
        known = lambda: held(("phrases", key), lambda: {lang: Numbers(own) for lang, own in shared.value.items()})
        routed = docs.mapInArrow(lambda it: route(numbered(it, known()), buckets, often), shape)
    else:
        routed = by_join(docs, numbers).mapInArrow(lambda it: route(joined(it), buckets, often), shape)
    mined = routed.groupBy("bucket").applyInArrow(lambda t: mine_bucket(t, often, least), "phrase binary, n long")
    single = numbers.select(F.unhex(F.lpad(F.hex("number"), 8, "0")).alias("phrase"), F.col("f").alias("n"))
    phrases = mined.groupBy("phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least).unionByName(single.withColumnRenamed("n", "f"))
    return staged(phrases, "phrases"), numbers, totals


def spelt(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``phrase`` in words instead of numbers."""
    at = F.explode(F.sequence(F.lit(0), (F.length("phrase") / 4 - 1).cast("int"))).alias("at")
    number = F.conv(F.hex(F.substring(F.col("phrase"), F.col("at") * 4 + 1, F.lit(4))), 16, 10).cast("int")
    words = rows.select("phrase").distinct().select("phrase", at).select("phrase", "at", number.alias("number")).join(numbers.select("number", "word"), "number")
    text = words.groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("text"))
    return rows.join(text, "phrase").drop("phrase").withColumnRenamed("text", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``listed`` strongest phrases of two to five words.

    ``docs`` needs lang and text; other columns are ignored.  A null lang is 'und', a null
    text empty; repeated rows count each, whatever their doc_id; a language without
    frequent phrases, and an empty table, give no rows.  Ties go by count, then by the
    phrase's bytes, so ranks are unique.
    """
    grams, numbers, totals = frequent_phrases(docs, least)
    words = (F.length("phrase") / 4).cast("int")
    candidates = grams.where(words > 1).withColumnRenamed("f", "a")
    # A phrase is as frequent as any phrase around it or more, and so is all in between: one word more tells.
    outer = candidates.where(words > 2)
    wide = F.length("phrase") - 4
    inside = outer.select(F.explode(F.array(F.substring("phrase", F.lit(1), wide), F.substring("phrase", F.lit(5), wide))).alias("phrase"), "a")
    kept = candidates.join(inside.groupBy("phrase").agg(F.max("a").alias("longer")), "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cut = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.substring("phrase", F.lit(1), F.col("k") * 4).alias("left"), F.substring("phrase", F.col("k") * 4 + 1, F.lit(4 * LONGEST)).alias("right"))
    cut = cut.join(grams.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(grams.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    first = numbers.select("lang", F.unhex(F.lpad(F.hex("number"), 8, "0")).alias("head"))
    totals = F.broadcast(totals) if small_enough(totals, LANGUAGES) else totals
    scored = (
        cut.withColumn("head", F.substring("phrase", F.lit(1), F.lit(4))).join(first, "head").drop("head").join(totals, "lang")
        .withColumn("score", F.expr("(1000BD * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    strong = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    top = staged(weakest.withColumn("rank", F.rank().over(strong)).where(F.col("rank") <= listed).drop("rank"), "collocations")  # with ties
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelt(top, numbers).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
