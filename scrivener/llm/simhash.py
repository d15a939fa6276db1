"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at Hamming distance ``3`` or less.  Two fingerprints within
distance two have a common neighbour at distance one, so each *distinct*
fingerprint emits itself and its 64 one-bit variants, and all that meet at a
variant are linked: no check is needed, the smallest of the bucket is a star's
centre, and a bucket never holds more than 65.  At distance three, erasing one
of three parts of the 64 bits leaves at most two differing bits, so fingerprints
emit the one-bit variants of the three erased forms.  Buckets whose members are
in one component already (all but a few) are dropped by an aggregate; in the
rest, members of different components are compared bit by bit.

Exact copies share a fingerprint and enter once, with their smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_staged, small_enough, staged

SEED = 42
RADIUS = 3
#: Parts of the 64 bits, as (first, end).
PARTS = ((0, 21), (21, 42), (42, 64))
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Most bucket keys of 8 bytes that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits: bit b is set if over half of the hashes of the ``width``-word shingles have it.

    Fewer words than ``width`` make one shingle; no word gives zero.
    """
    words = (text or b"").translate(_FOLD).split()  # on bytes, split() parts at \\t-\\r and the space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, texts, by their fingerprints."""
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The long columns ``keep``, doc_id and fp, a signed 64-bit integer, of every row; a null text has no words."""
    plain = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(fingerprint_rows, "".join(f"{c} long, " for c in keep) + "doc_id long, fp long")


def flips(first: int = 0, end: int = 64) -> list[int]:
    """Masks that flip no bit or one bit outside ``first..end`` (signed)."""
    masks = [0] + [1 << b for b in range(64) if not first <= b < end]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keep(first: int, end: int) -> int:
    """Mask (signed) of all bits but ``first..end``."""
    kept = ~(((1 << end) - 1) ^ ((1 << first) - 1)) & ((1 << 64) - 1)
    return kept - (1 << 64) if kept >> 63 else kept


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, comp (the smallest node reachable).

    Each round every node takes the smallest label among its own, its neighbours'
    and its label's label, so labels travel ever farther; rounds end when none
    changes.  Labels are written to the shared folder each round.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        known = labels.select("node", "comp")
        near = both.join(known, both.b == known.node).select(both.a.alias("node"), "comp")
        up = known.alias("x").join(known.alias("y"), F.col("x.comp") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.comp").alias("comp"))
        least = near.union(up).groupBy("node").agg(F.min("comp").alias("new"))
        after = staged(known.join(least, "node", "left").select("node", F.least("comp", F.coalesce("new", "comp")).alias("comp"), F.coalesce(F.col("new") < F.col("comp"), F.lit(False)).alias("moved")), "labels")
        drop_staged(labels)
        if after.where("moved").isEmpty():
            drop_staged(both)
            return after.select("node", "comp")
        labels = after


#: Fingerprints whose variants one task emits: few enough for its partial aggregates to stay in memory.
EMIT = 12_000


def emitters(df: DataFrame) -> DataFrame:
    """``df`` dealt out by fingerprint to tasks of about EMIT rows."""
    return df.repartition(-(-df.count() // EMIT) or 1, "fp")


def near_links(distinct: DataFrame) -> DataFrame:
    """Star edges (a, b) that connect all fingerprints (column fp, distinct) within distance two."""
    variants = emitters(distinct).select("fp", F.explode(F.array(*[F.lit(m) for m in flips()])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("fp").alias("n")).where("n > 1")
    pairs = met.where("n = 2").select("a", "b")
    # Three and more at a variant: every member gets an edge to the smallest.
    crowded = staged(met.where("n > 2").select("variant", "a"), "crowded")
    crowded = F.broadcast(crowded) if small_enough(crowded, BROADCAST_KEYS) else crowded
    return pairs.union(variants.join(crowded, "variant").where("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def far_links(distinct: DataFrame) -> DataFrame:
    """Edges between fingerprints at distance three that lie in different components (columns fp, comp)."""
    forms = F.array(*[F.struct(F.lit(keep(a, b)).alias("keep"), F.lit(1 << a).alias("mark"), F.array(*[F.lit(m) for m in flips(a, b)]).alias("masks")) for a, b in PARTS])
    one = emitters(distinct).select("fp", "comp", F.explode(forms).alias("form")).select(
        "fp", "comp", F.col("fp").bitwiseAND(F.col("form.keep")).bitwiseOR(F.col("form.mark")).alias("kept"), F.explode("form.masks").alias("mask")
    )  # the mark, a bit of the erased part, keeps most buckets of different parts apart; the comparison settles the rest
    emitted = one.select("fp", "comp", F.col("kept").bitwiseXOR(F.col("mask")).alias("bucket"))
    mixed = emitted.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("bucket")
    mixed = staged(mixed, "mixed")
    members = staged(emitted.join(F.broadcast(mixed) if small_enough(mixed, BROADCAST_KEYS) else mixed, "bucket"), "members")
    x, y = members.alias("x"), members.alias("y")
    close = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") < F.col("y.comp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
    return x.join(y, close).select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct()


def connected(prints: DataFrame) -> DataFrame:
    """fp and comp of every fingerprint in ``prints`` (column fp): equal comp where chains of links lead."""
    distinct = staged(prints.select("fp").distinct(), "distinct")
    near = components(near_links(distinct))
    grouped = staged(distinct.join(near, distinct.fp == near.node, "left").select("fp", F.coalesce("comp", "fp").alias("comp")), "grouped")
    far = components(far_links(grouped))
    return staged(grouped.join(far, grouped.comp == far.node, "left").select("fp", F.coalesce(far.comp, grouped.comp).alias("comp")), "joined")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id that chains of links reach, the document
    itself included; documents without words share fingerprint zero and so one
    component.  A null doc_id is kept and counts as larger than all others.
    """
    prints = staged(fingerprints(docs), "prints")
    comps = connected(prints)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    heads = comps.join(first, "fp").groupBy("comp").agg(F.min("first").alias("component_id"))
    named = comps.join(heads, "comp").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Most row numbers (8 bytes each) that are broadcast to drop rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their component.

    First is the smallest doc_id (null last), and of equal ones the first in the table; so
    of equal rows, or rows that share a doc_id and are near copies, one stays.
    """
    packed = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = staged(packed, "rows")
    prints = staged(fingerprints(rows.select("number", "row.doc_id", "row.text"), "number"), "prints")
    comps = connected(prints)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    heads = comps.join(prints.groupBy("fp").agg(F.min(order).alias("first")), "fp").groupBy("comp").agg(F.min("first").alias("head"))
    named = comps.join(heads, "comp").select("fp", F.col("head.number").alias("head"))
    gone = staged(prints.join(named, "fp").where(F.col("number") != F.col("head")).select("number"), "gone")
    return rows.join(F.broadcast(gone) if small_enough(gone, BROADCAST_ROWS) else gone, "number", "left_anti").select("row.*")
