"""Binary dictionary files as a Spark data source.

Little-endian: a header of 24 bytes (8 bytes magic, u32 version, u16 language length,
u16 zero, u32 words, u32 string table length), 14 bytes for each word (u32 offset,
u16 length, u32 frequency, u32 flags), the string table, the language.  The magic
is a parameter, so files of other writers of this layout can be read.

``spark.read.format("dictionary").option("path", p)`` gives the words of a file, or of all
files of a folder that the tasks can open, each in a partition of its own;
``df.coalesce(1).write.format("dictionary")`` writes one (a few thousand words, by
definition of the format) to a path that the driver can open. For a store that only
Spark reaches, read with :func:`decoded`, and take :func:`blobs` and write its column.  ``mode`` strict applies the limits of the engine.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .vocabulary import SCHEMA, TABLE_BYTES, WORDS

MAGIC = b"SCRVDICT"
VERSION = 1
HEADER, ENTRY = struct.Struct("<8sIHHII"), struct.Struct("<IHII")
#: Nodes of the engine's letter tree, with its root.
TREE_NODES = 32_768
# Engine result codes.
INVALID_INPUT, BAD_MAGIC, BAD_VERSION, OUT_OF_BOUNDS, EMPTY = -1, -2, -3, -4, -5
REASON_OF = {
    INVALID_INPUT: "INVALID_INPUT", BAD_MAGIC: "DICTIONARY_INVALID_MAGIC", BAD_VERSION: "DICTIONARY_UNSUPPORTED_VERSION",
    OUT_OF_BOUNDS: "DICTIONARY_BOUNDS_ERROR", EMPTY: "DICTIONARY_EMPTY",
}


class DictionaryError(ValueError):
    """A file that cannot be used; ``code`` as the engine reports it."""

    def __init__(self, code: int, why: str):
        super().__init__(why)
        self.code = code


def encode(entries: list[tuple[str, int, int]], language: str = "en-US", magic: bytes = MAGIC) -> bytes:
    """Entries (word, frequency, flags) in their order.  Words must be non-empty, lower case and unique, numbers u32."""
    table, rows, seen = bytearray(), [], set()
    for word, frequency, flags in entries:
        if not word or word != word.lower() or word in seen:
            raise DictionaryError(INVALID_INPUT, f"not a non-empty, lower-case, unique word: {word!r}")
        if not all(isinstance(n, int) and 0 <= n < 2**32 for n in (frequency, flags)):
            raise DictionaryError(INVALID_INPUT, f"frequency and flags of {word!r} must be integers of 32 bits")
        seen.add(word)
        raw = word.encode()
        rows.append(ENTRY.pack(len(table), len(raw), frequency, flags))
        table += raw
    lang = language.encode()
    return HEADER.pack(magic, VERSION, len(lang), 0, len(rows), len(table)) + b"".join(rows) + bytes(table) + lang


def decode(blob: bytes, strict: bool = False, magic: bytes = MAGIC) -> tuple[str, list[tuple[int, str, int, int]]]:
    """Language and rows (load_order, word, frequency, flags).  Nothing is returned of a file with any fault."""

    def need(sound: bool, code: int, why: str) -> None:
        if not sound:
            raise DictionaryError(code, why)

    need(len(blob) >= HEADER.size, INVALID_INPUT, "too short for a header")
    found, version, lang_bytes, zero, words, table_bytes = HEADER.unpack_from(blob)
    need(found == magic, BAD_MAGIC, "another magic")
    need(version == VERSION, BAD_VERSION, f"version {version}")
    need(zero == 0, OUT_OF_BOUNDS, "reserved bytes are not zero")
    if strict:
        need(words > 0 and table_bytes > 0, EMPTY, "no words")
    table_at = HEADER.size + words * ENTRY.size
    need(len(blob) == table_at + table_bytes + lang_bytes, OUT_OF_BOUNDS, "another length than the header says")
    if strict:
        need(words <= WORDS and table_bytes <= TABLE_BYTES, OUT_OF_BOUNDS, "over the engine's capacity")
    rows, seen, prefixes = [], set(), {b""}
    for k in range(words):
        offset, length, frequency, flags = ENTRY.unpack_from(blob, HEADER.size + k * ENTRY.size)
        need(length > 0 and offset + length <= table_bytes, OUT_OF_BOUNDS, f"word {k} lies outside the string table")
        raw = blob[table_at + offset : table_at + offset + length]
        need(raw not in seen, OUT_OF_BOUNDS, f"word {k} repeats")
        seen.add(raw)
        if strict:
            need(all(97 <= c <= 122 for c in raw), OUT_OF_BOUNDS, f"word {k} has other characters than a-z")
            prefixes.update(raw[: n + 1] for n in range(length))
            need(len(prefixes) <= TREE_NODES, OUT_OF_BOUNDS, "over the engine's capacity")
        try:
            rows.append((k, raw.decode(), frequency, flags))
        except UnicodeDecodeError:
            raise DictionaryError(OUT_OF_BOUNDS, f"word {k} is no UTF-8") from None
    return blob[table_at + table_bytes :].decode(), rows


class Dictionary(DataSource):
    """Options: path; mode (lenient or strict); language; magic (8 characters)."""

    @classmethod
    def name(cls) -> str:
        return "dictionary"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DictionaryReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DictionaryWriter(self.options)


class DictionaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("mode", "lenient") == "strict"
        self.magic = options.get("magic", MAGIC.decode()).encode()

    def partitions(self) -> list[InputPartition]:
        """One for each file: the path, or those of a folder."""
        if not os.path.isdir(self.path):
            return [InputPartition(self.path)]
        return [InputPartition(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from decode(f.read(), self.strict, self.magic)[1]


@dataclass
class Part(WriterCommitMessage):
    content: bytes | None


class DictionaryWriter(DataSourceWriter):
    """Writes one file from one partition.

    A partition sends its bytes (a few thousand words at most) with its message, so nothing
    lies on the disk of its machine; the commit puts those that have words into place. Of two, a
    file would hold one's words only, so that is an error and nothing is left.
    """

    def __init__(self, options: dict):
        self.path, self.language, self.magic = options["path"], options.get("language", "en-US"), options.get("magic", MAGIC.decode()).encode()

    def write(self, rows: Iterator) -> WriterCommitMessage:
        found = sorted(((r["load_order"], r["word"], r["frequency"], r["flags"]) for r in itertools.islice(rows, WORDS + 1)), key=lambda r: r[0])
        if len(found) > WORDS:
            raise DictionaryError(INVALID_INPUT, f"more than {WORDS} words")
        return Part(encode([r[1:] for r in found], self.language, self.magic) if found else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m.content for m in messages if m is not None and m.content]
        if len(parts) > 1:
            raise DictionaryError(INVALID_INPUT, f"words in {len(parts)} partitions: coalesce(1) before writing a dictionary")
        if parts:
            making = f"{self.path}.making-{uuid.uuid4().hex}"
            with open(making, "wb") as f:
                f.write(parts[0])
            os.replace(making, self.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Dictionary)


def source(spark: SparkSession, content: bytes | None = None, load: Callable[[], bytes] | None = None, path: str | None = None) -> DataFrame:
    """(path, content) of a dictionary from the first that is given: its bytes, a function that loads them, a path that Spark can read.

    Without any, or where the bytes are no dictionary that the engine takes, a ``DictionaryError`` tells why.
    """
    if content is None and load is not None:
        content = load()
    if content is None and path is None:
        raise DictionaryError(INVALID_INPUT, "a dictionary source must give bytes, load or path")
    if content is None:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    try:
        decode(bytes(content), strict=True)
    except DictionaryError as fault:
        raise DictionaryError(fault.code, f"dictionary load failed: {fault} ({REASON_OF[fault.code]})") from None
    return spark.createDataFrame([("", bytearray(content))], "path string, content binary")


def decoded(blobs: DataFrame, strict: bool = False, magic: bytes = MAGIC) -> DataFrame:
    """Words of binary files read by Spark (columns path, content of ``format("binaryFile")``), from any store it can read.

    One row a word; a faulty file gives one row with its error code instead of words.
    """

    def rows(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    language, words = decode(bytes(content), strict, magic)
                    out += [(path, 0, language, *w) for w in words]
                except DictionaryError as fault:
                    out.append((path, fault.code, None, None, str(fault), None, None))
            yield pd.DataFrame(out, columns=["path", "code", "language", "load_order", "word", "frequency", "flags"], dtype=object)

    return blobs.select("path", "content").mapInPandas(rows, f"path string, code int, language string, {SCHEMA}")


def blobs(dictionaries: DataFrame, key: str = "name", language: str = "en-US", magic: bytes = MAGIC) -> DataFrame:
    """(key, content): the binary form of each dictionary of a table; one has at most a few thousand words."""
    rows = F.array_sort(F.collect_list(F.struct("load_order", "word", "frequency", "flags")))
    packed = dictionaries.groupBy(key).agg(rows.alias("rows"))

    def pack(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({key: batch[key], "content": [encode([(r["word"], int(r["frequency"]), int(r["flags"])) for r in rows], language, magic) for rows in batch["rows"]]})

    return packed.mapInPandas(pack, f"`{key}` string, content binary")
