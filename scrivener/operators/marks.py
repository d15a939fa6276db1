"""Corrections applied to texts, their transactions and marks, and what later edits do to marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.text import let, placed, running
from .tokens import only, placed_tokens, unprotected


#: Corrections that are sought in the texts themselves; of more, all tokens of the texts are looked up.
FEW = 200


def edit_lists(docs: DataFrame, decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """The texts that any correction changes: key, digest (of the text), edits (sorted), and text where the list was found beside it.

    A few corrections become one pattern, which finds their tokens row by row; nothing is
    shuffled then, and equal rows each have their list.  Of many corrections only those that
    occur are shuffled; rows that share a key are told apart by the digest, and equal rows
    are one.  A text's own corrections bound its list.
    """
    fixes = unprotected(decided.where("action = 'auto_correct'").select("token", "replacement", "confidence", "reason_codes"), F.col("replacement").isNotNull())
    texts = docs.select(key, "text", F.xxhash64("text").alias("digest"))
    few = fixes.limit(FEW + 1).collect()
    if len(few) <= FEW:
        known = fixes.sparkSession.createDataFrame(few, fixes.schema).agg(F.collect_list(F.struct("*")).alias("fixes"))
        pattern = only([r["token"] for r in few])
        met = texts.where(F.col("text").rlike(pattern)).join(F.broadcast(known)) if few else texts.limit(0).join(known)
        fix = lambda m: F.get(F.filter("fixes", lambda f: f["token"] == m["piece"]), F.lit(0))
        edit = lambda m, f: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["piece"])).alias("end"), m["piece"].alias("original"), *[f[c].alias(c) for c in ("replacement", "confidence", "reason_codes")])
        return met.select(key, "digest", F.transform(placed(F.col("text"), pattern, 1), lambda m: let(fix(m), lambda f: edit(m, f))).alias("edits"), "text")
    found = placed_tokens(texts, key, "digest").join(fixes, "token")
    edit = F.struct("start", "end", F.col("token").alias("original"), "replacement", "confidence", "reason_codes")
    return found.groupBy(key, "digest").agg(F.array_sort(F.collect_set(edit)).alias("edits"))


def edits(docs: DataFrame, decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each correction: key, digest, start, end, original, replacement, confidence, reason_codes, n (its order), shift (of what follows, before it)."""
    deltas = running(F.transform("edits", lambda e: F.length(e["replacement"]) - F.length(e["original"])))
    before = lambda e, end: (end - F.length(e["replacement"]) + F.length(e["original"])).cast("int")
    counted = F.transform(F.arrays_zip(F.col("edits").alias("e"), deltas.alias("end")), lambda z, i: F.struct(z["e"].alias("e"), (i + 1).alias("n"), before(z["e"], z["end"]).alias("shift")))
    found = edit_lists(docs, decided, key)
    rows = found.select(key, "digest", F.explode(counted).alias("at")).select(key, "digest", "at.e.*", "at.n", "at.shift")
    return rows.dropDuplicates([key, "digest", "start"]) if "text" in found.columns else rows


def corrected(docs: DataFrame, edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """The texts that corrections change, by :func:`edit_lists` or :func:`edits`: key, digest (of the text before), text, n_edits."""
    listed = edited
    if "edits" not in edited.columns:
        listed = edited.groupBy(key, "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end", "replacement"))).alias("edits"))
    parts = F.transform("edits", lambda e, i: F.concat(spans.cut(F.col("text"), F.when(i == 0, 0).otherwise(F.get("edits", i - 1)["end"]), e["start"]), e["replacement"]))
    rest = F.substring(F.col("text"), F.element_at("edits", -1)["end"] + 1, F.length("text"))
    found = listed
    if "text" not in listed.columns:
        found = docs.select(key, "text", F.xxhash64("text").alias("digest")).join(listed, [key, "digest"])
    return found.select(key, "digest", F.concat(F.array_join(parts, ""), rest).alias("text"), F.size("edits").cast("long").alias("n_edits"))


def transactions(edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ranges before and after each correction, and the blue mark it leaves.

    One counter numbers all that a session makes: a correction, then its mark.
    """
    at = F.col("start") + F.col("shift")
    return edited.select(
        key, "digest", F.concat(F.lit("correction-"), 2 * F.col("n") - 1).alias("id"), F.concat(F.lit("mark-"), 2 * F.col("n")).alias("mark_id"), "start", "end", "original", "replacement", "confidence", "reason_codes",
        at.alias("new_start"), (at + F.length("replacement")).alias("new_end"), F.lit("blue_applied_correction").alias("mark"),
    )


def reverted(texts: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Single reverts (key, digest, new_start, new_end, original, replacement) tried on corrected texts: result and the text after it.

    ``reverted`` where the range still holds the replacement as a word; else ``stale_range``,
    or ``missing_text`` where there is no such text.
    """
    joined = done.join(texts.select(key, "digest", "text").distinct(), [key, "digest"], "left")
    fits = spans.still_matches(F.col("text"), F.col("new_start"), F.col("new_end"), F.col("replacement"))
    result = F.when(F.col("text").isNull(), "missing_text").when(fits, "reverted").otherwise("stale_range")
    return joined.withColumn("result", result).withColumn("text", F.when(F.col("result") == "reverted", spans.replaced(F.col("text"), F.col("new_start"), F.col("new_end"), F.col("original"))).otherwise(F.col("text")))


def suggested(texts: DataFrame, marks: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """Suggestions taken from the popovers of red marks, each tried alone: result, the transaction and the text after it.

    ``chosen`` (key, mark_id, suggestion), ``marks`` (key, mark_id, mark_start, mark_end,
    mark_text, original, reason_codes) and ``texts`` (key, text).  ``missing_mark`` where there is
    no such mark, ``stale_range`` where its range no longer holds its text as a word, else
    ``applied``: a transaction of full confidence that the popover triggered, and a blue mark.
    """
    joined = chosen.join(marks, [key, "mark_id"], "left").join(texts.select(key, "text"), key, "left")
    fits = spans.still_matches(F.col("text"), F.col("mark_start"), F.col("mark_end"), F.col("mark_text"))
    result = F.when(F.col("mark_start").isNull(), "missing_mark").when(fits, "applied").otherwise("stale_range")
    done = F.col("result") == "applied"
    of = lambda c, name: F.when(done, c).alias(name)
    return joined.withColumn("result", result).select(
        key, "mark_id", "result", of(F.col("mark_start"), "start"), of(F.col("mark_end"), "end"), of(F.coalesce("original", "mark_text"), "original"), of(F.col("suggestion"), "replacement"),
        of(F.col("mark_start"), "new_start"), of(F.col("mark_start") + F.length("suggestion"), "new_end"), of(F.lit("popover"), "trigger"), of(F.lit(1.0), "confidence"),
        of(F.coalesce("reason_codes", F.expr("cast(array() as array<string>)")), "reason_codes"), of(F.lit("blue_applied_correction"), "mark"),
        F.when(done, spans.replaced(F.col("text"), F.col("mark_start"), F.col("mark_end"), F.col("suggestion"))).otherwise(F.col("text")).alias("text"),
    )


def shifted(marks: DataFrame, edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """Marks (key, mark_start, mark_end and others) after edits (key, start, end, replacement): moved by what stands before them, gone where one overlaps.

    One pass: edits and marks of a text are sorted together and a running sum gives
    the move; an overlap shows in the nearest edits before and after.
    """
    e = edited.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("end").alias("edit_end"), (F.length("replacement") - (F.col("end") - F.col("start"))).alias("delta"), F.lit(None).cast(marks.drop(key).schema).alias("m"))
    m = marks.select(key, F.col("mark_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("edit_end"), F.lit(0).alias("delta"), F.struct(*[F.col(c) for c in marks.columns if c != key]).alias("m"))
    order = Window.partitionBy(key).orderBy("at", "kind")
    past, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    both = e.unionByName(m).withColumns({
        "move": F.sum("delta").over(past), "reach": F.max("edit_end").over(past),
        "next": F.min(F.when(F.col("kind") == 0, F.col("at"))).over(later),
    })
    kept = both.where((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") <= F.col("m.mark_start"))) & (F.col("next").isNull() | (F.col("next") >= F.col("m.mark_end"))))
    return kept.select(key, "m.*", F.col("move").cast("int").alias("move")).withColumns({"mark_start": F.col("mark_start") + F.col("move"), "mark_end": F.col("mark_end") + F.col("move")}).drop("move")


def surviving(marks: DataFrame, texts: DataFrame, policy: str = "same_offset", key: str = "doc_id") -> DataFrame:
    """Marks (key, mark_start, mark_end, original, version) that outlive a change of text (key, text, version).

    ``version``: none that are older; ``same_offset``: where the text at the same place is the same;
    ``decoration``: the same, where a blue mark (column kind) looks for its replacement instead.
    """
    now = marks.join(texts.select(key, F.col("text").alias("now"), F.col("version").alias("now_version")), key)
    text = F.when(F.col("kind").startswith("blue"), F.col("replacement")).otherwise(F.col("original")) if policy == "decoration" else F.col("original")
    kept = now.where(F.col("version") == F.col("now_version")) if policy == "version" else now.where(spans.holds(F.col("now"), F.col("mark_start"), F.col("mark_end"), text))
    return kept.select(*marks.columns)


#: Characters of a bin in which ranges meet.
BIN = 64


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of ranges (start, end) of one text that overlap, as (key, l_start, l_end, r_start, r_end).

    Ranges meet in the bins they touch; a pair counts in the bin where its later one begins.
    """
    first = lambda c: F.floor(F.col(c) / BIN).cast("int")
    binned = lambda df, s, e: df.withColumn("bin", F.explode(F.sequence(first(s), F.floor(F.greatest(F.col(s), F.col(e) - 1) / BIN).cast("int"))))
    x = binned(left.select(key, F.col("start").alias("l_start"), F.col("end").alias("l_end")), "l_start", "l_end")
    y = binned(right.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end")), "r_start", "r_end")
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("bin") == F.greatest(first("l_start"), first("r_start")))
    return x.join(y, [key, "bin"]).where(meet).drop("bin")


def with_transactions(marks: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Marks (key, mark_start, mark_end, original, event_id and others) with the id, original, replacement, new_start and new_end of their transaction.

    A mark whose transaction is not known (or that names none) gets one made of itself: its
    own place, and its text as original and replacement.  Adds ``known``.
    """
    t = done.select(key, F.col("id").alias("event_id"), F.lit(True).alias("known"), F.col("original").alias("t_original"), F.col("replacement").alias("t_replacement"), F.col("new_start").alias("t_start"), F.col("new_end").alias("t_end"))
    joined = marks.join(t, [key, "event_id"], "left")
    return joined.select(
        *marks.columns, F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("t_original", "original").alias("before"), F.coalesce("t_replacement", "original").alias("replacement"),
        F.coalesce("t_start", "mark_start").alias("new_start"), F.coalesce("t_end", "mark_end").alias("new_end"),
    )


def completion_reverted(texts: DataFrame, accepted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reverts of accepted completions (key, at, inserted) on texts (key, text): result and the text after it.

    ``reverted`` where exactly the inserted text stands at its place, whatever version the
    text has; ``stale_range`` where it does not, ``missing_transaction`` for a text without one.
    """
    joined = texts.join(accepted, key, "left")
    end = F.col("at") + F.length("inserted")
    result = F.when(F.col("inserted").isNull() | F.col("at").isNull(), "missing_transaction").when(spans.holds(F.col("text"), F.col("at"), end, F.col("inserted")), "reverted").otherwise("stale_range")
    return joined.withColumn("result", result).withColumn("text", F.when(F.col("result") == "reverted", spans.replaced(F.col("text"), F.col("at"), end, F.lit(""))).otherwise(F.col("text")))


def deduplicated(marks: DataFrame, *columns: str) -> DataFrame:
    """Marks that differ in some column; nulls are equal."""
    return marks.dropDuplicates(list(columns))


def rendered(text: Column, marks: Column) -> Column:
    """Text as HTML with its marks (array of struct start, end, kind) around their ranges.

    By start, then end, blue before red; a mark that overlaps an earlier one is left out.
    """
    ranked = F.array_sort(F.transform(marks, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(m["kind"].startswith("blue"), -2).otherwise(-1).alias("priority"), m["kind"].alias("kind"))))
    span = lambda m: F.concat(F.lit('<mark class="'), spans.escaped(m["kind"], True), F.lit('">'), spans.escaped(spans.cut(text, m["start"], m["end"])), F.lit("</mark>"))
    # The fold chooses the marks; what they hold is cut and joined once.
    start = F.struct(F.lit(0).alias("at"), F.filter(ranked, lambda m: F.lit(False)).alias("kept"))
    add = lambda done, m: F.when((m["start"] >= done["at"]) & (m["end"] > m["start"]), F.struct(m["end"].alias("at"), F.concat(done["kept"], F.array(m)).alias("kept"))).otherwise(done)

    def html(kept: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(kept, i - 1)["end"])
        parts = F.transform(kept, lambda m, i: F.concat(spans.escaped(spans.cut(text, before(i), m["start"])), span(m)))
        past = F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(parts, ""), spans.escaped(F.substring(text, past + 1, F.length(text))))

    return let(F.aggregate(ranked, start, add, lambda done: done["kept"]), html)
