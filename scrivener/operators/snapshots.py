"""Edit scripts between snapshots of a text, and marks carried through them.

A script is the list of ranges that differ: what stands at both ends of the texts is
skipped, and a longest common subsequence aligns the rest.  A mark lives as long as no
edit touches its text; its place moves by the edits before it, and an insertion at its
edge stays outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNKS = "array<struct<start:int,end:int,new_start:int,new_end:int>>"
#: Bits of an alignment's table that are kept at once; larger ones are aligned by halves.
TABLE = 1 << 28


def shared(a: str, b: str) -> int:
    """Length of the longest common beginning; halves are compared as wholes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def table(a: str, b: str, keep: bool = True) -> list[int]:
    """For each character of ``b`` (only the last unless ``keep``), the places of ``a`` as bits: 0 where the common subsequence up to there gets longer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row, rows = every, []
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & every
        if keep:
            rows.append(row)
    return rows if keep else [row]


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both texts, ascending."""
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE and len(b) > 1:
        half = len(b) // 2
        bits = lambda row: np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
        longest = lambda x, y: np.concatenate([[0], np.cumsum(1 - bits(table(x, y, False)[0]).astype(np.int64))])
        cut = int((longest(a, b[:half]) + longest(a[::-1], b[half:][::-1])[::-1]).argmax())
        return matches(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in matches(a[cut:], b[half:])]
    rows, found = table(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                found.append((i, j))
    return found[::-1]


def hunks(before: str, after: str) -> list[tuple[int, int, int, int]]:
    """Ranges (start, end, new_start, new_end) that differ, in order; between them the texts are equal."""
    if before == after:
        return []
    head = shared(before, after)
    tail = shared(before[head:][::-1], after[head:][::-1])
    a, b = before[head : len(before) - tail], after[head : len(after) - tail]
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((head + i, head + x, head + j, head + y))
        i, j = x + 1, y + 1
    return out


def script(before: pd.Series, after: pd.Series) -> pd.Series:
    names = ("start", "end", "new_start", "new_end")
    return pd.Series([None if a is None or b is None else [dict(zip(names, h)) for h in hunks(a, b)] for a, b in zip(before, after)])


def scripts(snapshots: DataFrame, key: str, version: str, text: str = "text") -> DataFrame:
    """(key, version, hunks): how each snapshot but a key's first came from the one before it."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(version))
    made = snapshots.select(key, version, F.col(text).alias("after"), before.alias("before")).where("before is not null and after is not null")
    return made.select(key, version, F.pandas_udf(script, HUNKS)("before", "after").alias("hunks"))


def moved(starts: np.ndarray, ends: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of marks after edits (rows of start, end, new_start, new_end), and which of them no edit touches."""
    if not len(edits):
        return starts, ends, np.ones(len(starts), bool)
    start, end, _, new_end = edits.T
    last = np.searchsorted(end, starts, "right") - 1  # edits that end at a mark's start or before it
    shift = np.where(last >= 0, new_end[last] - end[last], 0)
    next_ = last + 1  # an edit that reaches over the start; at an end, or past it, none does
    free = (next_ >= len(edits)) | (start[np.minimum(next_, len(edits) - 1)] >= ends)
    return starts + shift, ends + shift, free


def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of scripts and marks in order (a version's script before its marks); keeps the living marks of one key."""
    key, living = None, None
    names = ["start", "end", "new_start", "new_end"]

    def rows(marks: pd.DataFrame, lost: bool, version: int | None = None) -> pd.DataFrame:
        return marks.assign(lost_at=version if lost else None)

    for batch in batches:
        out = []
        edges = np.flatnonzero((batch["key"].ne(batch["key"].shift()) | batch["kind"].ne(batch["kind"].shift()) | batch["version"].ne(batch["version"].shift())).to_numpy())
        for a, b in zip(edges, [*edges[1:], len(batch)]):
            part = batch.iloc[a:b]
            own, kind, version = part["key"].iat[0], part["kind"].iat[0], part["version"].iat[0]
            if own != key:
                if living is not None and len(living):
                    out.append(rows(living, False))
                key, living = own, None
            if kind == 1:
                new = part[["key", "mark", "mark_start", "mark_end"]]
                living = new if living is None else pd.concat([living, new], ignore_index=True)
            elif living is not None and len(living):
                edits = np.array([[h[n] for n in names] for h in part["hunks"].iat[0]], np.int64).reshape(-1, 4)
                starts, ends, free = moved(living["mark_start"].to_numpy(np.int64), living["mark_end"].to_numpy(np.int64), edits)
                if not free.all():
                    out.append(rows(living[~free], True, int(version)))
                living = living.assign(mark_start=starts, mark_end=ends)[free]
        if out:
            yield pd.concat(out, ignore_index=True)[["key", "mark", "mark_start", "mark_end", "lost_at"]].astype({"lost_at": "Int64"})
    if living is not None and len(living):
        yield rows(living, False)[["key", "mark", "mark_start", "mark_end", "lost_at"]].astype({"lost_at": "Int64"})


def carried(marks: DataFrame, made: DataFrame, key: str, version: str) -> DataFrame:
    """Marks (key, version at which they were set, mark_start, mark_end and others) through :func:`scripts`.

    Adds lost_at, the version whose edit touched the mark, null while it lives; mark_start and
    mark_end are its last place.  A key's rows stream through one task in order of their
    versions; no more than its living marks is held.
    """
    columns = [c for c in marks.columns if c not in (key, "mark_start", "mark_end")]
    plain = lambda c: F.to_json(F.struct(F.col(c).alias("k"))).alias("key")
    edits = made.select(plain(key), F.col(version).cast("long").alias("version"), F.lit(0).alias("kind"), "hunks", F.lit(None).cast("string").alias("mark"), F.lit(0).alias("mark_start"), F.lit(0).alias("mark_end"))
    kept = F.to_json(F.struct(key, *columns)).alias("mark")
    set_ = marks.select(plain(key), F.col(version).cast("long").alias("version"), F.lit(1).alias("kind"), F.lit(None).cast(HUNKS).alias("hunks"), kept, "mark_start", "mark_end")
    both = edits.unionByName(set_).repartition("key").sortWithinPartitions("key", "version", "kind")
    out = both.mapInPandas(lambda it: carry(it), "key string, mark string, mark_start int, mark_end int, lost_at long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marks.select(key, *columns).schema)
    return out.select(F.from_json("mark", schema).alias("m"), "mark_start", "mark_end", "lost_at").select("m.*", "mark_start", "mark_end", "lost_at")


def at(place: Column, edits: Column, after: bool) -> Column:
    """Where one offset goes under a script: past an insertion at it if ``after``, else before it."""
    h = F.element_at(F.filter(edits, lambda e: e["start"] <= place), -1)
    inside = (place < h["end"]) | ((place == h["end"]) & (h["start"] == h["end"]) & F.lit(not after))
    edge = F.when((place == h["start"]) & (h["end"] > h["start"]) | F.lit(not after), h["new_start"]).otherwise(h["new_end"])
    return F.when(F.size(F.filter(edits, lambda e: e["start"] <= place)) == 0, place).when(inside, edge).otherwise(place - h["end"] + h["new_end"])
