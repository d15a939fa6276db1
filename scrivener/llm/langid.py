"""Language ID by prediction by partial matching over bytes.

For each language a context tree of orders 0 to 3 counts which byte follows which
context.  The code length of a byte starts at the longest context the tree has:
a byte seen there ``c`` times of ``n`` with ``d`` different ones costs
``-log2(c / (n + d))``, any other pays the escape ``-log2(d / (n + d))`` and goes
on at the next shorter context, at last to a uniform byte.  A text's language is
the one whose frozen tree gives the shortest code.

Trees are counted on the executors from a bounded sample (``sample`` documents of
each language) and kept whole.  Scoring looks up exact code lengths, kept for the
byte four-grams, trigrams and pairs the trees hold, for all languages at once; a
trigram's four-grams lie together, and bits tell which last bytes it has, so the
index grows with the trigrams only.

Languages are meant to be few (some hundreds): each is a column of the tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, held_out

#: Documents of each language that are counted: about so many, picked by a hash of doc_id.
SAMPLE = 1500
#: Bytes of text, times languages, that are scored at once: bounds a worker's arrays.
ROOM = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
PAD = b"   "


def folded(text: str) -> bytes:
    """Lower-case UTF-8 with one space for each run of ASCII other than letters, after the padding."""
    return PAD + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "


def grams(data: np.ndarray) -> np.ndarray:
    """Codes of the four bytes that end at each position from the fourth on."""
    b = data.astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, code, n), summed within each batch."""
    for batch in batches:
        texts: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if LETTER.search(text):
                texts.setdefault(lang, []).append(grams(np.frombuffer(folded(text), dtype=np.uint8)))
        for lang, codes in texts.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def costs(code: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One order of the trees.  ``counts[g, l]``: how often language l has gram ``code[g]``; ``lower``: the gram's code length one order down.

    Gives each gram's code length, and the contexts with what an escape from each costs.
    """
    context, first = np.unique(code >> np.uint32(8), return_index=True)
    n = np.add.reduceat(counts, first, axis=0)
    d = np.add.reduceat(counts > 0, first, axis=0)
    of = np.searchsorted(context, code >> np.uint32(8))
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
        own = -np.log2(counts / (n + d)[of])
    return np.where(counts > 0, own, escape[of] + lower), context, escape


@dataclass
class Trees:
    """Frozen statistics as code lengths in bits, one column for each language."""

    langs: list[str]
    pairs: np.ndarray  # by first byte * 256 + second
    trigrams: np.ndarray  # codes that any tree has
    trigram_bits: np.ndarray
    pair_escape: np.ndarray  # of contexts of two bytes, by code
    quads: np.ndarray
    quad_bits: np.ndarray
    trigram_escape: np.ndarray  # of contexts of three bytes, by place in trigrams
    index: tuple | None = field(default=None, repr=False)

    @classmethod
    def build(cls, langs: list[str], code: np.ndarray, counts: np.ndarray) -> "Trees":
        """From ascending four-gram codes and their counts by language."""

        def folded_to(mask: int) -> tuple[np.ndarray, np.ndarray]:
            short, place = np.unique(code & np.uint32(mask), return_inverse=True)
            out = np.zeros((len(short), len(langs)))
            np.add.at(out, place, counts)
            return short, out

        singles, one = folded_to(0xFF)
        bits0 = np.zeros((256, len(langs)))
        n, d = one.sum(axis=0), (one > 0).sum(axis=0)
        with np.errstate(divide="ignore"):
            bits0[:] = np.where(n > 0, -np.log2(d / np.maximum(n + d, 1)), 0.0) + 8.0
            bits0[singles] = np.where(one > 0, -np.log2(one / (n + d)), bits0[singles])
        dense = np.zeros((65536, len(langs)))
        pair, two = folded_to(0xFFFF)
        dense[pair] = two
        bits1, _, _ = costs(np.arange(65536, dtype=np.uint32), dense, np.tile(bits0, (256, 1)))
        trigrams, three = folded_to(0xFFFFFF)
        bits2, held2, escape2 = costs(trigrams, three, bits1[trigrams & np.uint32(0xFFFF)])
        pair_escape = np.zeros((65536, len(langs)))
        pair_escape[held2] = escape2
        quads, four = code, counts
        # A context of three bytes may begin a text and be no trigram yet: give it a place.
        every = np.union1d(trigrams, np.unique(quads >> np.uint32(8)))
        full = pair_escape[every >> np.uint32(8)] + bits1[every & np.uint32(0xFFFF)]
        full[np.searchsorted(every, trigrams)] = bits2
        lower = full_bits(quads & np.uint32(0xFFFFFF), every, full, pair_escape, bits1)
        bits3, held3, escape3 = costs(quads, four, lower) if len(quads) else (np.zeros((0, len(langs))), np.zeros(0, np.uint32), np.zeros((0, len(langs))))
        trigram_escape = np.zeros_like(full)
        trigram_escape[np.searchsorted(every, held3)] = escape3
        small = np.float32
        return cls(langs, bits1.astype(small), every, full.astype(small), pair_escape.astype(small), quads, bits3.astype(small), trigram_escape.astype(small))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of trigrams by code (0: none); for each place and quarter of the byte range, bits of the last bytes of its four-grams, and how many four-grams lie before."""
        if self.index is None:
            by_code = np.zeros(1 << 24, np.int32)
            by_code[self.trigrams] = np.arange(1, len(self.trigrams) + 1)
            slot = by_code[self.quads >> np.uint32(8)].astype(np.int64) * 4 + ((self.quads >> np.uint32(6)) & np.uint32(3))
            bits = np.zeros((len(self.trigrams) + 1) * 4, np.uint64)
            np.bitwise_or.at(bits, slot, np.uint64(1) << (self.quads & np.uint32(63)).astype(np.uint64))
            before = np.zeros(len(bits) + 1, np.int32)
            np.cumsum(np.bincount(slot, minlength=len(bits)), out=before[1:])
            self.index = by_code, bits, before
        return self.index

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-gram after the other three."""
        by_code, bits, earlier = self.tables()
        before = by_code[code >> np.uint32(8)]
        slot = before * 4 + ((code >> np.uint32(6)) & np.uint32(3)).astype(np.int32)
        own, bit = bits[slot], (code & np.uint32(63)).astype(np.uint64)
        has = (own >> bit & np.uint64(1)).astype(bool)
        quad = earlier[slot] + np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
        out = self.quad_bits[np.where(has, quad, 0)] if len(self.quads) else np.zeros((len(code), len(self.langs)), np.float32)
        rest = np.flatnonzero(~has)
        if len(rest):
            c = code[rest] & np.uint32(0xFFFFFF)
            place, held = by_code[c], before[rest]
            low = np.where((place > 0)[:, None], self.trigram_bits[place - 1], self.pair_escape[c >> np.uint32(8)] + self.pairs[c & np.uint32(0xFFFF)])
            out[rest] = low + np.where((held > 0)[:, None], self.trigram_escape[held - 1], np.float32(0))
        return out

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior under equal priors; ``und`` and 0 where a text has no letter or nothing was learned."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        at, slot, data = 0, [], []

        def flush() -> None:
            if slot:
                sizes = np.array([len(x) for x in data])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                bits = self.bits(grams(np.frombuffer(b"".join([*data, PAD]), dtype=np.uint8)))
                ends = starts + sizes - len(PAD)  # the three grams after these mix two texts
                total = np.add.reduceat(bits, np.stack([starts, ends], axis=1).ravel(), axis=0, dtype=np.float64)[::2]
                best = total.argmin(axis=1)
                chance = 1 / np.exp2(np.clip(total.min(axis=1, keepdims=True) - total, -1000, 0)).sum(axis=1)
                for i, b, p in zip(slot, best.tolist(), chance.tolist()):
                    out[i] = (self.langs[b], p)
                slot.clear(), data.clear()

        for i, text in enumerate(texts):
            if self.langs and text and LETTER.search(text):
                slot.append(i)
                data.append(folded(text))
                at += len(data[-1])
                if at * len(self.langs) > ROOM:
                    flush()
                    at = 0
        flush()
        return out


def full_bits(code: np.ndarray, trigrams: np.ndarray, bits: np.ndarray, pair_escape: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Code lengths by contexts of two bytes, also of trigrams that no tree has."""
    if not len(code):
        return np.zeros((0, bits.shape[1]))
    place = np.minimum(np.searchsorted(trigrams, code), len(trigrams) - 1)
    return np.where((trigrams[place] == code)[:, None], bits[place], pair_escape[code >> np.uint32(8)] + pairs[code & np.uint32(0xFFFF)])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees of every non-null ``lang`` of ``docs`` (doc_id, text, lang) with a text.

    About ``sample`` different (doc_id, text) of each language are drawn by a hash, and
    each is counted once however often it is repeated.  The driver gets one row for
    each language, and one for each four-gram and language of that sample.  Languages
    without a letter in their sample are not learned.
    """
    known = docs.select(F.xxhash64(F.lit("language sample"), "doc_id", F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang is not null and text is not null")
    many = known.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()
    if not many:
        return Trees([], *[np.zeros((0, 0))] * 7)
    share = F.create_map(*[x for r in many for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / max(1, r["n"]))))])
    drawn = known.where(F.pmod("mark", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).groupBy("lang", "mark").agg(F.first("text").alias("text"))
    rows = drawn.select("text", "lang").mapInArrow(count_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return Trees([], *[np.zeros((0, 0))] * 7)
    langs = sorted(rows["lang"].unique())
    code, place = np.unique(rows["code"].to_numpy().astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(code), len(langs)))
    counts[place, np.searchsorted(langs, rows["lang"].to_numpy().astype(str))] = rows["n"]
    return Trees.build(langs, code, counts)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """Adds lang_pred and score to ``docs``; columns of those names are replaced."""
    spark = docs.sparkSession
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(trees)  # languages times the grams of the bounded sample
    plain = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, lambda: shared.value)
        for batch in batches:
            lang, score = zip(*model.score(batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = plain.schema
    for name, kind in (("lang_pred", "string"), ("score", "double")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return plain.mapInArrow(rows, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Learns from rows that are not held out, and predicts from the text alone.
    ``und`` with score 0 where the text is null or has no letter, or no language
    could be learned; of equal code lengths the first language in order wins.
    """
    trees = learn(docs.where(~held_out("doc_id")), sample)
    return predict(docs.select("doc_id", "text"), trees).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
