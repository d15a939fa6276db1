"""Token-ID output: a content-addressed chunk store for encoded documents.

Writing makes one pass over the texts.  Each document becomes token ids plus an
end id; a rolling hash over the ids cuts the stream where its low bits are zero,
so that equal passages give equal chunks wherever they stand.  A chunk's address
is the BLAKE2b digest of its bytes.  Chunks of all documents meet in one
shuffle by address, where each is kept once (Spark's partial aggregation drops
repeats before the shuffle, so a group of copies never meets in one task).

Files, all Parquet under one folder::

    objects/kind=chunk     address, ids: little-endian unsigned integers
    objects/kind=recipe    unordered recipes, an intermediate that recipes/ replaces
    recipes                part, doc_id, local_start, n_tokens, chunks, root; ascending doc_id
    manifest               part, first_doc, n_docs, n_tokens, start, root
    root                   the Merkle root over the parts

``part`` numbers the ranges of ascending doc_id.  A recipe lists its chunks
(address, length); ``root`` is the Merkle root over those addresses, and the
manifest's ``root`` the one over the recipes of the part.

Reading recomputes every address and root, raises on a difference, and derives a
document's checksum from those of its chunks (CRC-32 is linear), so no payload is
shuffled again.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, held

ADDRESS = 16
#: A unit holding one of these code points is left to the library's own splitting: newer
#: Unicode versions classify some of them differently.
RARE = re.compile(r"[\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7F1\uAB6C\uAB6D\U00010000-\U0010ffff\x1c-\x1f\x85]")
#: How byte-level BPE vocabularies of this family split text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@dataclass(frozen=True)
class StoreFormat:
    """Parameters of the file format; the cut rule is part of it."""

    vocabulary: str = "byte_bpe_50k.json"
    end_id: int = 0
    id_bytes: int = 2
    window: int = 16
    shortest: int = 128
    mean_bits: int = 9
    longest: int = 2048


class UnitEncoder(dict):
    """Ids of space-delimited units as bytes, each unit encoded once.

    A byte-level BPE never merges over a boundary between a non-space and a
    space, so a text's ids are those of its units in turn.  Units that end in
    white space (or are empty) can merge with what follows; they map to None,
    and :meth:`text` hands such texts whole to the library, as it does those that
    hold an added token's string.
    """

    #: Units that are kept since the last turn; those of the turn before stay until the next.
    LIMIT = 600_000

    def __init__(self, vocabulary: str, id_bytes: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.model = self.library.model
        self.kind = np.dtype(f"<u{id_bytes}")
        self.code = {2: "H", 4: "I"}[id_bytes]
        self.pieces: dict[str, bytes] = {}
        self.former: dict[str, bytes | None] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def merged(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin1").translate(self.alphabet)
        return self.pack([t.id for t in self.model.tokenize(mapped)])

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self.merged(piece)
        return found

    def unit(self, unit: str) -> bytes:
        if RARE.search(unit):
            return self.pack(self.library.encode(unit, add_special_tokens=False).ids)
        return b"".join(map(self.piece, PIECES.findall(unit)))

    def __missing__(self, word: str) -> bytes | None:
        made = self[word] = self.former[word] if word in self.former else self.made(word)
        return made

    def made(self, word: str) -> bytes | None:
        if not word or word[-1].isspace():
            made = None
        elif RARE.search(word):
            made = self.unit(" " + word)
        elif word.isalpha():
            made = self.merged(" " + word)
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():  # the commonest two pieces
            made = self[word[:-1]] + self.piece(word[-1])
        else:
            made = self.unit(" " + word)
        return made

    def text(self, text: str) -> bytes:
        if len(self) > self.LIMIT:  # common units are asked for again before they leave
            self.former = dict(self)
            self.clear()
            self.pieces.clear()
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and not any(t in text for t in self.added):
            try:
                return self.unit(first) + b"".join(map(self.__getitem__, rest))
            except TypeError:
                pass
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)


def encoder(form: StoreFormat) -> UnitEncoder:
    """One encoder for each Python worker."""
    key = (form.vocabulary, form.id_bytes)
    return held(("encoder", *key), lambda: UnitEncoder(*key))


def rolling(ids: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hashes of the ``window`` ids (a power of two) that end at each position."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    factor, span = 0x85EBCA6B, 1
    while span < window:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        h = h + older * np.uint32(factor)
        factor, span = factor * factor & 0xFFFFFFFF, span * 2
    return h ^ (h >> np.uint32(15))


def cuts(ids: np.ndarray, starts: np.ndarray, form: StoreFormat) -> list[list[int]]:
    """For each stream that begins at ``starts[k]`` (the last ends the array), the ends of its chunks.

    A cut needs ``shortest`` ids before it, more than the hash window, so it
    depends on nothing outside its own chunk.
    """
    marks = np.flatnonzero((rolling(ids, form.window) & np.uint32((1 << form.mean_bits) - 1)) == 0) + 1
    found = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = marks[np.searchsorted(marks, a, "right") : np.searchsorted(marks, b, "left")].tolist()
        ends, at = [], a
        for m in [*own, b]:
            while m - at > form.longest:
                at += form.longest
                ends.append(at)
            if m - at >= form.shortest or m == b and m > at:
                ends.append(m)
                at = m
        found.append(ends)
    return found


def merkle(addresses: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up unchanged, leaves and nodes hash apart."""
    level = [hashlib.blake2b(b"\0" + a, digest_size=ADDRESS).digest() for a in addresses] or [b"\0" * ADDRESS]
    while len(level) > 1:
        paired = [hashlib.blake2b(b"\1" + x + y, digest_size=ADDRESS).digest() for x, y in zip(level[::2], level[1::2])]
        level = paired + level[len(paired) * 2 :]
    return level[0]


OBJECT = pa.schema([("kind", pa.string()), ("address", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
LENGTH = np.dtype("<u4")


def encode_objects(batches: Iterator[pa.RecordBatch], form: StoreFormat) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, copy) to chunk rows and one recipe row for each document."""
    enc = encoder(form)
    end = enc.pack([form.end_id])
    digest = hashlib.blake2b
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            piece = batch.slice(part, 512)
            ids_of, texts, copies = (c.to_pylist() for c in piece.columns)
            streams = [enc.text(t or "") + end for t in texts]
            data = b"".join(streams)
            starts = np.concatenate([[0], np.cumsum([len(s) // form.id_bytes for s in streams])]).astype(np.int64)
            rows: dict[bytes, tuple] = {}
            recipes = []
            for doc_id, copy, a, b, ends in zip(ids_of, copies, starts[:-1].tolist(), starts[1:].tolist(), cuts(np.frombuffer(data, dtype=enc.kind), starts, form)):
                at, listed, lengths = a, [], []
                for e in ends:
                    payload = data[at * form.id_bytes : e * form.id_bytes]
                    address = digest(payload, digest_size=ADDRESS).digest()
                    rows.setdefault(address, ("chunk", address, None, e - at, payload))
                    listed.append(address)
                    lengths.append(e - at)
                    at = e
                recipes.append(("recipe", digest(f"{doc_id}:{copy}".encode(), digest_size=ADDRESS).digest(), doc_id, b - a, np.array(lengths, dtype=LENGTH).tobytes() + b"".join(listed)))
            columns = zip(*rows.values(), *[()] * 0) if not recipes else zip(*[*rows.values(), *recipes])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OBJECT)], schema=OBJECT)


def addresses(packed: bytes) -> list[bytes]:
    """The chunk addresses of a recipe, which stand behind their lengths."""
    k = len(packed) // (LENGTH.itemsize + ADDRESS)
    return [packed[k * LENGTH.itemsize + i * ADDRESS :][:ADDRESS] for i in range(k)]


MANIFEST = "part int, first_doc long, n_docs long, n_tokens long, root binary, start long"
RECIPE = "part int, doc_id long, local_start long, n_tokens long, chunks binary, root binary"


def order_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one range in ascending doc_id: adds the part, the ids before each and its Merkle root."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.array(batch.column("n").to_pylist(), dtype=np.int64)
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        roots = []
        for packed in batch.column("ids").to_pylist():
            roots.append(merkle(addresses(packed)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(start), pa.array(n), batch.column("ids"), pa.array(roots, pa.binary())],
            names=["part", "doc_id", "local_start", "n_tokens", "chunks", "root"],
        )


def part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One manifest row for each part; a task reads whole parts in order."""
    seen: dict[int, list] = {}
    for batch in batches:
        for part, doc_id, n, root in zip(*(c.to_pylist() for c in batch.columns)):
            row = seen.setdefault(part, [doc_id, 0, 0, []])
            row[1] += 1
            row[2] += n
            row[3].append(f"{doc_id}:".encode() + root)  # which document it is counts too
    if seen:
        rows = [(p, r[0], r[1], r[2], merkle(r[3])) for p, r in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "first_doc", "n_docs", "n_tokens", "root"])


def write_store(docs: DataFrame, path: str, form: StoreFormat = StoreFormat()) -> None:
    """Encodes ``docs`` (doc_id, text) into a store at ``path``.

    A null text is empty and gives the end id alone; a null doc_id sorts first.
    Rows that repeat a doc_id each keep a recipe, in an order by content; an empty
    table gives empty files.  Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("copy"))
    objects = plain.mapInArrow(lambda it: encode_objects(it, form), "kind string, address binary, doc_id long, n long, ids binary")
    once = objects.groupBy("kind", "address").agg(*(F.first(c).alias(c) for c in ("doc_id", "n", "ids")))
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = (
        spark.read.schema("address binary, doc_id long, n long, ids binary, kind string").parquet(f"{path}/objects")
        .where("kind = 'recipe'").select("doc_id", F.xxhash64("ids").alias("content"), "address", "n", "ids")
    )
    # Rows of one doc_id may fill several ranges: their order goes on by content, and equal rows' by address.
    order = ("doc_id", "content", "address")
    recipes.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids").mapInArrow(order_recipes, RECIPE).write.parquet(f"{path}/recipes")
    drop_path(spark, f"{path}/objects/kind=recipe")
    manifest_of(spark.read.schema(RECIPE).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    root = root_of(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))
    spark.createDataFrame([(root,)], "root binary").write.parquet(f"{path}/root")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """The manifest that belongs to ``recipes``."""
    # Range partitions are contiguous, so a part's root needs its own rows only; they come in file order.
    parts = (
        recipes.select("part", "doc_id", "n_tokens", "root", "local_start").repartition("part").sortWithinPartitions("part", "local_start")
        .select("part", "doc_id", "n_tokens", "root").mapInArrow(part_roots, "part int, first_doc long, n_docs long, n_tokens long, root binary")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part, never more
    return parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def root_of(manifest: DataFrame) -> bytes:
    """The Merkle root over the parts' roots, in order: a root for each range partition, a few thousand at most."""
    return merkle([bytes(r["root"]) for r in manifest.orderBy("part").select("root").collect()])


def check_chunks(batches: Iterator[pa.RecordBatch], form: StoreFormat) -> Iterator[pa.RecordBatch]:
    """Recomputes each chunk's address; yields its length and CRC-32 as 32-bit ids."""
    kind = np.dtype(f"<u{form.id_bytes}")
    for batch in batches:
        found, lengths, sums = batch.column("address").to_pylist(), [], []
        for address, payload in zip(found, batch.column("ids").to_pylist()):
            if hashlib.blake2b(payload, digest_size=ADDRESS).digest() != address:
                raise ValueError(f"chunk {address.hex()} does not match its address")
            lengths.append(len(payload) // form.id_bytes)
            sums.append(zlib.crc32(np.frombuffer(payload, dtype=kind).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["address", "n", "crc"])


#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def times(a: np.ndarray, b: int) -> np.ndarray:
    """Products modulo the CRC polynomial of reflected 32-bit polynomials."""
    out, a = np.zeros_like(a), a.copy()
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = (a >> np.uint64(1)) ^ np.where(a & np.uint64(1), np.uint64(POLYNOMIAL), np.uint64(0))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What blocks with CRC-32 ``crc`` add to the CRC-32 of a stream with ``after`` bytes behind them."""
    out, power, left = crc.astype(np.uint64), 0x00800000, after.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = times(out[odd], power)
        power = int(times(np.array([power], np.uint64), power)[0])
        left >>= 1
    return out


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes to one row for each chunk in them, with the bytes of 32-bit ids behind it; checks the roots."""
    for batch in batches:
        rows = []
        for part, doc_id, start, packed, root in zip(*(c.to_pylist() for c in batch.columns)):
            listed = addresses(packed)
            lengths = np.frombuffer(packed[: len(listed) * LENGTH.itemsize], dtype=LENGTH).astype(np.int64)
            if merkle(listed) != root:
                raise ValueError(f"the recipe of document {doc_id} does not match its root")
            after = lengths.sum() - np.cumsum(lengths)
            rows += [(part, doc_id, start, address, int(n), int(b) * 4) for address, n, b in zip(listed, lengths, after)]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "doc_id", "local_start", "address", "length", "after"])


def shift_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = (batch.column(c).to_numpy() for c in ("crc", "after"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("part", "doc_id", "local_start", "n", "same")] + [pa.array(shifted(crc, after).astype(np.int64))],
            names=["part", "doc_id", "local_start", "n", "same", "crc"],
        )


def verify_parts(spark: SparkSession, path: str) -> None:
    """Recomputes the manifest from the recipes: each part's first document, counts and Merkle root, and the running starts and the root over all parts."""
    spark_parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    made = manifest_of(spark.read.schema(RECIPE).parquet(f"{path}/recipes"))
    said = spark_parts.select("part", F.struct(*[F.col(c) for c in ("first_doc", "n_docs", "n_tokens", "root", "start")]).alias("said"))
    found = made.select("part", F.struct(*[F.col(c) for c in ("first_doc", "n_docs", "n_tokens", "root", "start")]).alias("found"))
    wrong = said.join(found, "part", "full").where(~F.col("said").eqNullSafe(F.col("found"))).orderBy("part").limit(1).collect()
    if wrong:
        raise ValueError(f"part {wrong[0]['part']}: the manifest says {wrong[0]['said']}, its recipes {wrong[0]['found']}")
    top = [bytes(r["root"]) for r in spark.read.schema("root binary").parquet(f"{path}/root").collect()]
    if top != [root_of(spark_parts)]:
        raise ValueError("the store's root does not match its manifest")


def read_store(spark: SparkSession, path: str, form: StoreFormat = StoreFormat()) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32.

    Raises where a chunk, recipe or manifest does not match its digest, where a recipe
    names a chunk that is missing, where a part's recipes are not those that the manifest
    counts and hashes, and where the manifest or the recipes lack a part.
    """
    verify_parts(spark, path)
    chunks = (
        spark.read.schema("address binary, ids binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'").select("address", "ids")
        .mapInArrow(lambda it: check_chunks(it, form), "address binary, n long, crc long")
    )
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    manifest = spark.read.schema("part int, start long").parquet(f"{path}/manifest")
    listed = recipes.select("part", "doc_id", "local_start", "chunks", "root").mapInArrow(unpack, "part int, doc_id long, local_start long, address binary, length long, after long")
    joined = listed.join(chunks, "address", "left").select("part", "doc_id", "local_start", "n", F.coalesce(F.col("n") == F.col("length"), F.lit(False)).alias("same"), F.coalesce("crc", F.lit(0)).alias("crc"), "after")
    parts = joined.mapInArrow(shift_rows, "part int, doc_id long, local_start long, n long, same boolean, crc long")
    docs = parts.groupBy("part", "local_start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.min("same").alias("same"))
    # The manifest has one row for each range partition: a few thousand at most.
    return docs.join(F.broadcast(manifest.select("part", F.col("start").alias("before"))), "part").select(
        "doc_id",
        (F.col("before") + F.col("local_start")).alias("start"),
        F.when(F.col("same"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length"))).cast("long").alias("n_tokens"),
        "ids_crc32",
    )


def token_store(docs: DataFrame, path: str | None = None, form: StoreFormat = StoreFormat()) -> DataFrame:
    """Writes a store (by default in the shared folder) and reads it back."""
    path = path or fresh_path(docs.sparkSession, "token-store")
    write_store(docs, path, form)
    return read_store(docs.sparkSession, path, form)
