"""Best-fit packing of tokenised documents into sequences of fixed capacity.

One pass over the texts encodes each document and cuts it where it is longer than a
sequence; the pieces are written once.  All that the packing needs of them is how many
there are of each length, at most ``CAPACITY`` numbers however large the corpus is.

Over that histogram stands the configuration linear program: a variable for each
multiset of lengths that fits a sequence, a constraint for each length.  Multiplicative
weights solve it: a length's price is its tokens times exp(-rate x share covered so far),
and knapsack dynamic programming finds for every length the most valuable configuration
that holds it.  Configurations near the best one enter with amounts under which no length
is covered too fast, and prices fall.  Rounding takes whole multiples of the
configurations while pieces last; what is left goes, longest first, to the sequence with
the least room that holds it.

A configuration used m times is m sequences, so the plan is a short table of slots.  The
r-th piece of a length (running counts by task, then a sum over tasks) finds its slot by
binary search; no piece meets another in a group.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, small_enough, staged

CAPACITY = 4096
VOCABULARY, END = "word_bpe_49k.json", 1
#: Rounds of multiplicative weights, the rate at which prices fall, the share of a length that a
#: round covers at most, and how far from the best a configuration's value may be.
ROUNDS, RATE, COVERED, SLACK = 16, 10.0, 0.1, 0.1
#: Rows (task, length) of running counts that are sent to all tasks instead of shuffled.
BROADCAST_ROWS = 20_000


class WordEncoder(dict):
    """Ids of units between spaces and line feeds as little-endian 16-bit integers, each unit encoded once.

    The vocabulary's splitting drops white space and merges nothing over it, and its
    normalisation looks at no more than a unit, so a text's ids are those of its units.
    """

    #: Units that are kept since the last turn; those of the turn before stay until the next.
    LIMIT = 700_000

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.former: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        #: Units of these alone need no normal form, and the vocabulary's splitting is known for them; all others go to the library.
        self.simple = re.compile(r"(?!.*<\|)[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies write other bytes as code points from 256 on
        self.letters = dict(zip([b for b in range(256) if b not in set(shown)], range(256, 512)))

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u2").tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self.pack([t.id for t in self.library.model.tokenize(piece.encode().decode("latin1").translate(self.letters))])
        return found

    def __missing__(self, unit: str) -> bytes:
        found = self.former.get(unit)
        if found is None:
            if unit.isascii() and unit.isalpha():
                found = self.piece(unit.lower())
            elif unit.isascii() and unit[:-1].isalpha() and unit[-1] in ".,;:!?":
                found = self.piece(unit[:-1].lower()) + self.piece(unit[-1])
            elif self.simple(unit):
                found = b"".join(map(self.piece, self.split(unit.lower())))
            else:
                found = self.pack(self.library.encode(unit, add_special_tokens=False).ids)
        self[unit] = found
        return found

    def text(self, text: str) -> bytes:
        if len(self) > self.LIMIT:  # common units are asked for again before they leave
            self.former = dict(self)
            self.clear()
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(vocabulary: str) -> WordEncoder:
    return held(("packing", vocabulary), lambda: WordEncoder(vocabulary))


PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, task int, place long"


def encode_pieces(batches: Iterator[pa.RecordBatch], vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to pieces; ``place`` numbers a task's pieces of one length."""
    from pyspark import TaskContext

    task, made, end = TaskContext.get().partitionId(), [0] * (capacity + 1), WordEncoder.pack([END])
    enc = encoder(vocabulary)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                ids = enc.text(text or "") + end
                for k, a in enumerate(range(0, len(ids) // 2, capacity)):
                    own = ids[2 * a : 2 * (a + capacity)]
                    n = len(own) // 2
                    rows.append((doc_id, k, a, n, own, zlib.crc32(np.frombuffer(own, "<u2").astype("<u4")), task, made[n]))
                    made[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "place"])


Configuration = tuple[tuple[int, int], ...]


class Knapsack:
    """Most valuable multisets of lengths for every room up to ``capacity``; no length is used more often than it occurs."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, capacity: int):
        self.best = np.zeros(capacity + 1)
        self.taken: list[tuple[int, int]] = []
        rooms, items = [], []
        for length in np.flatnonzero(counts)[::-1].tolist():
            left, k = min(int(counts[length]), capacity // length), 1
            while left > 0:  # a bounded number of copies as packs of 1, 2, 4, ...
                many = min(k, left)
                left, k = left - many, 2 * k
                size = many * length
                gain = self.best[: capacity + 1 - size] + many * values[length]
                better = np.flatnonzero(gain > self.best[size:] * (1 + 1e-12))
                np.maximum(self.best[size:], gain, out=self.best[size:])
                rooms.append((better + size).astype(np.int32))
                items.append(np.full(len(better), len(self.taken), np.int32))
                self.taken.append((length, many))
        at, item = np.concatenate(rooms), np.concatenate(items)
        order = np.argsort(at, kind="stable")
        self.item, self.ends = item[order], np.searchsorted(at[order], np.arange(capacity + 2)).tolist()

    def filling(self, room: int) -> dict[int, int]:
        """The multiset behind ``best[room]``."""
        found: dict[int, int] = {}
        upto = len(self.taken)
        while room > 0:
            a, b = self.ends[room], self.ends[room + 1]
            k = a + int(np.searchsorted(self.item[a:b], upto)) - 1
            if k < a:
                break
            upto = int(self.item[k])
            length, many = self.taken[upto]
            found[length] = found.get(length, 0) + many
            room -= length * many
        return found


@dataclass
class Fractional:
    """Amounts by configuration, the share of each length that they cover, and a bound that no packing can beat."""

    amounts: dict[Configuration, float]
    covered: np.ndarray
    bound: float


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE, share: float = COVERED, slack: float = SLACK) -> Fractional:
    """The configuration program over ``counts`` (pieces by length) by multiplicative weights."""
    present = np.flatnonzero(counts)
    covered, amounts, bound = np.zeros(len(counts)), defaultdict(float), 0.0
    for _ in range(rounds if len(present) else 0):
        price = np.zeros(len(counts))
        price[present] = present * np.exp(-rate * (covered[present] - covered[present].min()))
        pack = Knapsack(price, counts, capacity)
        most = pack.best[capacity]
        bound = max(bound, float((price * counts).sum() / most))  # prices / most is feasible for the dual
        room = share * counts
        for length in present[::-1].tolist():
            if room[length] <= 0 or price[length] + pack.best[capacity - length] < (1 - slack) * most:
                continue
            held_ = pack.filling(capacity - length)
            held_[length] = held_.get(length, 0) + 1
            amount = min(room[k] / m for k, m in held_.items())
            if amount > 0:
                amounts[tuple(sorted(held_.items(), reverse=True))] += amount
                for k, m in held_.items():
                    room[k] -= amount * m
                    covered[k] += amount * m / counts[k]
    return Fractional(dict(amounts), covered, bound)


def rounded(counts: np.ndarray, solution: Fractional, capacity: int = CAPACITY) -> list[tuple[int, Configuration]]:
    """Whole numbers of sequences by configuration that hold every piece exactly once."""
    left = counts.copy()
    open_: list[list[tuple[int, Configuration]]] = [[] for _ in range(capacity + 1)]
    some = solution.covered[solution.covered > 0]
    scale = 1 / np.median(some) if len(some) else 0
    for held_, amount in sorted(solution.amounts.items(), key=lambda x: (-x[1], x[0])):
        many = min([int(amount * scale), *(int(left[k]) // m for k, m in held_)])
        if many > 0:
            for k, m in held_:
                left[k] -= many * m
            open_[capacity - sum(k * m for k, m in held_)].append((many, held_))
    has = np.array([bool(x) for x in open_])
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            fits = np.flatnonzero(has[length:])
            room = length + int(fits[0]) if len(fits) else capacity
            many, held_ = open_[room].pop() if len(fits) else (-(-todo // (capacity // length)), ())
            each = room // length
            full = min(many, todo // each)
            now, copies = (full, each) if full else (1, todo)
            for n, r, c in ((now, room - copies * length, (*held_, (length, copies))), (many - now, room, held_)):
                if n and c:
                    open_[r].append((n, c))
                has[r] = bool(open_[r])
            todo -= now * copies
    return [x for some in open_ for x in some]


@dataclass
class Slots:
    """Where the pieces of each length go: for pieces from ``first`` on, ``each`` to a sequence from ``sequence`` on, at ``offset``."""

    first: dict[int, list[int]]
    place: dict[int, list[tuple[int, int, int]]]
    sequences: int

    def find(self, length: int, rank: int) -> tuple[int, int]:
        """Sequence and offset of the rank-th piece of a length."""
        first = self.first[length]
        k = bisect_right(first, rank) - 1
        sequence, each, offset = self.place[length][k]
        past, own = divmod(rank - first[k], each)
        return sequence + past, offset + own * length


def slots(plan: list[tuple[int, Configuration]]) -> Slots:
    first, place, used, at = defaultdict(list), defaultdict(list), defaultdict(int), 0
    for many, held_ in plan:
        offset = 0
        for length, each in held_:
            first[length].append(used[length])
            place[length].append((at, each, offset))
            used[length] += many * each
            offset += length * each
        at += many
    return Slots(dict(first), dict(place), at)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (16-bit, little-endian), ids_crc32, sequence_id, offset: every piece and its place.

    A null or empty text is its end id alone.  Rows that repeat a doc_id, or have none,
    are documents of their own; an empty table gives no rows; other columns are ignored.
    Pieces of equal length are alike to the packing: which of them goes where follows
    the order of the table.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = staged(plain.mapInArrow(lambda it: encode_pieces(it, vocabulary, capacity), PIECES), "pieces")
    made = staged(pieces.groupBy("task", "length").agg((F.max("place") + 1).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(slots(rounded(counts, solve(counts, capacity), capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        find = shared.value.find
        return pd.DataFrame([find(a, b) for a, b in zip(length.tolist(), rank.tolist())], columns=["sequence_id", "offset"])

    # A length has one row for each task that read it, not for each piece.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bases = F.broadcast(bases) if small_enough(made, BROADCAST_ROWS) else bases
    ranked = pieces.join(bases, ["task", "length"]).withColumn("slot", place("length", F.col("before") + F.col("place")))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "slot.sequence_id", "slot.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, starts: whole sequences, and where each document in them begins.

    A group is one sequence, so never more than the capacity.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts")
    joined: Column = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts).select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))


def digest(packed: DataFrame) -> DataFrame:
    """Places without the ids."""
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
