"""Secret scans over a blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger, Parquet in the shared folder, remembers which blob was scanned by which
rule version and what was found; a scan reads the texts of unseen pairs only,
appends them, and joins the findings back to all paths with that content.

Positions come from the gaps between matches: ``split`` by a rule's pattern gives
the gaps, ``regexp_extract_all`` the matches, and running sums of their lengths the places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, path_exists


@dataclass(frozen=True)
class Rule:
    """A pattern; ``part``: the group that must have ``least`` characters; ``hint``: a cheaper pattern each match contains."""

    kind: str
    version: int
    pattern: str
    hint: str
    part: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: A run is maximal, so asking for its least length in the pattern is the same as dropping short runs.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)password|passwd|secret|token|api_?key", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"
LEDGER = f"blob binary, scanned array<string>, spans {SPAN}"


NONE = f"cast(array() as {SPAN})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column) -> Column:
    """Running sums of an array of n integers.

    In blocks of about the root of n: no step copies what earlier ones gave, as a fold
    that extends an array would, so the memory is in proportion to n.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    def sums(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        block = lambda i: F.floor(i / width).cast("int")
        whole = F.transform(F.sequence(F.lit(0), block(F.size(x) - 1)), lambda k: total(F.slice(x, k * width + 1, width)))
        before = let(whole, lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))
        return let(before, lambda s: F.transform(x, lambda _, i: F.get(s, block(i)) + total(F.slice(x, block(i) * width + 1, i - block(i) * width + 1))))

    return let(lengths, lambda x: F.when(F.size(x) > 0, sums(x)).otherwise(F.expr("cast(array() as array<bigint>)")))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in a text, in code points; ``place`` orders kinds that start together."""
    sizes = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)  # one more than the matches

    def placed(matched: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(matched)), matched, lambda a, b: a + b))
        found = F.arrays_zip(ends.alias("end"), matched.alias("size"), sizes(rule.part).alias("part"))
        kept = F.filter(found, lambda m: m["part"] >= rule.least)
        return F.transform(kept, lambda m: F.struct((m["end"] - m["size"]).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))

    return F.when(text.rlike(rule.hint), let(sizes(0), placed)).otherwise(F.expr(NONE))


def addressed(history: DataFrame) -> DataFrame:
    """``history`` with the address of each text, a null one as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return history.drop("blob", "spans").withColumns({"blob": F.unhex(F.sha2(text.cast("binary"), 256)), "text": text})


def unseen(history: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What a scan adds to the ledger: findings of the blobs and rule versions of ``history`` (text) that it lacks."""
    spark = history.sparkSession
    blobs = addressed(history).groupBy("blob").agg(F.first("text").alias("text"))
    none = F.expr("cast(array() as array<string>)")
    if path_exists(spark, ledger_path):
        known = read_ledger(spark, ledger_path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        blobs = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", none))
    else:
        blobs = blobs.withColumn("seen", none)
    due = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))
    found = F.concat(*[F.when(F.array_contains("scanned", r.key), spans(F.col("text"), r, k)).otherwise(F.expr(NONE)) for k, r in enumerate(rules)])
    return blobs.withColumn("scanned", due).where(F.size("scanned") > 0).select("blob", "scanned", found.alias("spans"))


def record(history: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Appends :func:`unseen` to the ledger."""
    unseen(history, ledger_path, rules).write.mode("append").parquet(ledger_path)


def scan(history: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings for every row of ``history`` (path, text): adds ``spans``, sorted, to its other columns.

    Only blobs and rule versions that the ledger lacks are scanned.  A null text is
    an empty one, rows that repeat share one blob, and an empty table has no blobs.
    A pair that several scans have appended counts once.  Columns of ``history`` named
    blob or spans are replaced.
    """
    ledger_path = ledger_path or fresh_path(history.sparkSession, "ledger")
    record(history, ledger_path, rules)

    # Of each scan in the ledger, what the rules in use found in their version.
    def own(rule: Rule) -> Column:
        return F.when(F.array_contains("scanned", rule.key), F.filter("spans", lambda s: s["kind"] == rule.kind)).otherwise(F.expr(NONE))

    scanned = read_ledger(history.sparkSession, ledger_path).select("blob", F.concat(*map(own, rules)).alias("spans"))
    scanned = scanned.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return addressed(history).drop("text").join(scanned, "blob", "left")


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings(docs: DataFrame) -> DataFrame:
    """The columns of the contract for every row of ``docs`` (doc_id, text).

    The rows come as two batches of versions to one ledger: half of them by a hash, then
    all, of which only what the first batch has not brought is scanned.
    """
    history = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger = fresh_path(docs.sparkSession, "ledger")
    record(history.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    found = scan(history, ledger)
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE)))
    return found.select("doc_id", *[many(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
