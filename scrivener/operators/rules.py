"""The user's memory: own words and correction rules as change logs, their latest state, export, import, reset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_key

WORDS = "word string, created_at long"
RULES = "original string, replacement string, status string, created_at long, updated_at long"
#: Parts of the memory, as they are named in exports and resets.
PARTS = ("personal_dictionary", "correction_rules", "settings")
EXPORT = "version int, exportedAt string, personalDictionary array<struct<word:string,createdAt:long>>, correctionRules array<struct<original:string,replacement:string,status:string,createdAt:long,updatedAt:long>>, settings map<string,string>"


def own_words(log: DataFrame) -> DataFrame:
    """Each word once, in key form, since its first entry."""
    return log.select(token_key(F.col("word")).alias("word"), "created_at").where("word <> ''").groupBy("word").agg(F.min("created_at").alias("created_at"))


def latest_rules(log: DataFrame) -> DataFrame:
    """Rules in force after a log of settings (columns of RULES).

    An *always* rule replaces the former one of its original, whatever the
    replacement; a *never* rule belongs to its pair.  created_at is the first of the
    key's, updated_at the last.  Settings with an empty original or replacement set nothing.
    """
    keyed = log.select(token_key(F.col("original")).alias("original"), "replacement", "status", "created_at", "updated_at").where("original <> '' and replacement <> ''")
    keyed = keyed.withColumn("pair", F.when(F.col("status") == "never", F.col("replacement")).otherwise(""))
    newest = F.max_by(F.struct("replacement", "created_at"), F.struct("updated_at", "replacement"))
    state = keyed.groupBy("original", "status", "pair").agg(newest.alias("newest"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return state.select("original", "newest.replacement", "status", "created_at", "updated_at")


def latest_values(log: DataFrame) -> DataFrame:
    """Last value of each (namespace, key) of a store's change log (namespace, key, value, updated_at); null values are deletions."""
    newest = F.max_by("value", F.struct("updated_at", "value"))
    return log.groupBy("namespace", "key").agg(newest.alias("value"), F.max("updated_at").alias("updated_at")).where("value is not null")


def rule_for(rules: DataFrame, original: str, replacement: str | None = None) -> DataFrame:
    """The rule that answers a look-up: with a replacement never before always, without one always before never."""
    found = rules.where(F.col("original") == token_key(F.lit(original)))
    if replacement is not None:
        found = found.where(F.col("replacement") == replacement)
    first = "never" if replacement is not None else "always"
    return found.orderBy((F.col("status") != first), "created_at", "replacement").limit(1)


def without_rules(rules: DataFrame, cleared: DataFrame) -> DataFrame:
    """``rules`` but those of the pairs in ``cleared`` (original, replacement; a null replacement clears all of an original)."""
    gone = cleared.select(token_key(F.col("original")).alias("o"), F.col("replacement").alias("r"))
    return rules.join(gone, (F.col("original") == F.col("o")) & (F.col("r").isNull() | (F.col("r") == F.col("replacement"))), "left_anti")


def exported(words: DataFrame, rules: DataFrame, at: str, settings: DataFrame | None = None) -> DataFrame:
    """One row of the export document as JSON (column document), entries in alphabetical order.

    One user's memory is a few entries typed by hand, so one row may hold it.
    """
    entry = F.struct(F.collate(F.col("word"), "UNICODE").alias("k"), F.col("word").alias("word"), F.col("created_at").alias("createdAt"))
    a = words.where("word is not null and created_at is not null").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["word"].alias("word"), e["createdAt"].alias("createdAt"))).alias("personalDictionary"))
    names = ("original", "replacement", "status")
    rule = F.struct(*[F.collate(F.col(c), "UNICODE").alias(f"k{i}") for i, c in enumerate(names)], *names, F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"))
    b = rules.where("status in ('always', 'never') and original is not null and replacement is not null").agg(F.transform(F.array_sort(F.collect_list(rule)), lambda r: F.struct(*[r[c].alias(c) for c in (*names, "createdAt", "updatedAt")])).alias("correctionRules"))
    both = a.join(b, how="cross")  # one row each
    if settings is not None:
        c = settings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))
        both = both.join(c.withColumn("settings", F.when(F.size("settings") > 0, F.col("settings"))), how="cross")
    return both.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(at).alias("exportedAt"), *both.columns)).alias("document"))


@dataclass(frozen=True)
class Memory:
    """A user's memory by parts: words (WORDS), rules (RULES) and settings (key, value as JSON text)."""

    words: DataFrame
    rules: DataFrame
    settings: DataFrame


def imported(documents: DataFrame, now: int, onto: Memory | None = None) -> Memory:
    """What export documents (column document) hold; merged into ``onto`` if given, else instead of it.

    A document that is no export of version 1, or holds an entry without its texts, fails the
    job; entries without times get ``now``.  Documents without settings leave those of ``onto``
    as they are; a setting that several documents have is the last by the document's date.
    """
    parsed = documents.select(F.from_json("document", EXPORT).alias("d"))
    blank = lambda c: F.coalesce(token_key(c) == "", F.lit(True))
    bad_words = F.exists("d.personalDictionary", lambda w: blank(w["word"]))
    bad_rules = F.exists("d.correctionRules", lambda r: blank(r["original"]) | F.coalesce(r["replacement"] == "", F.lit(True)) | ~F.coalesce(r["status"].isin("always", "never"), F.lit(False)))
    sound = (F.col("d.version") == 1) & F.try_to_timestamp("d.exportedAt").isNotNull() & F.col("d.personalDictionary").isNotNull() & F.col("d.correctionRules").isNotNull() & ~bad_words & ~bad_rules
    body = parsed.select(F.when(sound, F.col("d")).otherwise(F.raise_error(F.lit("not an export of version 1"))).alias("d"))
    words = body.select(F.explode("d.personalDictionary").alias("w")).select("w.word", F.coalesce("w.createdAt", F.lit(now)).alias("created_at"))
    created = F.coalesce("createdAt", F.lit(now))
    rules = body.select(F.explode("d.correctionRules").alias("r")).select("r.*").select("original", "replacement", "status", created.alias("created_at"), F.coalesce("updatedAt", "createdAt", F.lit(now)).alias("updated_at"))
    entries = body.select(F.try_to_timestamp("d.exportedAt").alias("at"), F.explode("d.settings").alias("key", "value"))
    if onto is not None:
        words, rules = onto.words.unionByName(words), onto.rules.unionByName(rules)
        entries = onto.settings.select(F.lit(None).cast("timestamp").alias("at"), "key", "value").unionByName(entries)
    settings = entries.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    return Memory(own_words(words), latest_rules(rules), settings)


def reset(parts: dict[str, DataFrame], *named: str) -> dict[str, DataFrame]:
    """The memory with the named parts empty; all of them if none is named."""
    return {k: df.limit(0) if not named or k in named else df for k, df in parts.items()}


def memory_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Entries of each part: (namespace, entries)."""
    rows = [df.agg(F.count("*").alias("entries")).select(F.lit(k).alias("namespace"), "entries") for k, df in parts.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


__all__ = ["Memory", "exported", "imported", "latest_rules", "latest_values", "memory_counts", "own_words", "reset", "rule_for", "without_rules"]
