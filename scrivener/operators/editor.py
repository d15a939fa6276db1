"""Editor events: which delimiter was typed, what the settings let a decision do, and what a user's actions amount to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_delimiter


@dataclass(frozen=True)
class Settings:
    autocorrect: bool = True
    spellcheck: bool = True
    keep_marks: bool = True
    use_personal_dictionary: bool = True
    #: Corrections are applied only for these reasons, if any are named; others become marks.
    applied_reasons: tuple[str, ...] = ()


#: Reasons that a plain text field asks for.
TRUSTED = ("COMMON_TYPO_MATCH", "ALWAYS_CORRECT_RULE")


def typed_delimiter(data: Column, text: Column, caret: Column, look_back: bool = True) -> Column:
    """The delimiter that an input ends in: of its data, else (``look_back``) the one before the caret; null if none."""
    own = F.right(data, F.lit(1))
    before = F.when(caret > 0, F.substring(text, caret, F.lit(1)))
    char = F.when(F.coalesce(is_delimiter(own), F.lit(False)), own)
    return F.coalesce(char, F.when(is_delimiter(before), before)) if look_back else char


def trigger(delimiter: Column) -> Column:
    return F.when(delimiter == "\n", "newline").when(delimiter.isin(" ", "\t"), "space").otherwise("punctuation")


def ready(events: DataFrame) -> DataFrame:
    """Events (start, end, read_only, disabled, is_composing) on which a token may be decided."""
    off = F.lit(False)
    return events.where((F.col("start") == F.col("end")) & ~F.coalesce("read_only", off) & ~F.coalesce("disabled", off) & ~F.coalesce("is_composing", off))


def selection_dismissals(events: DataFrame, key: str = "session", *order: str) -> DataFrame:
    """Events (key, type, version, start, end, composing) that tell a completion to go, with reason.

    A *selection* that stands where the last input, accept, dismissal or counted selection left
    it is no news; an *input* dismisses where it composes or selects, else it asks anew.
    """
    window = Window.partitionBy(key).orderBy(*order)
    place = F.struct("version", "start", "end")
    # An event without news repeats the last that counted, so the one before it tells as much.
    known = F.last(F.when(F.col("type") != "blur", place), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    same = (F.col("type") == "selection") & F.coalesce(place.eqNullSafe(known), F.lit(False))
    reason = (
        F.when((F.col("type") == "input") & F.coalesce("composing", F.lit(False)), "composition").when((F.col("type") == "input") & (F.col("start") != F.col("end")), "selection_change")
        .when((F.col("type") == "selection") & ~same, "selection_change").when(F.col("type") == "blur", "blur")
    )
    return events.withColumn("reason", reason).where("reason is not null")


def still_shown(ghost: Column, now: Column) -> Column:
    """Whether a proposed completion may stay: structs (version, text, start, end) of when it was shown and of now, the latter with focused."""
    same = [ghost[c].eqNullSafe(now[c]) for c in ("version", "text", "start", "end")]
    return same[0] & same[1] & same[2] & same[3] & F.coalesce(now["focused"], F.lit(False))


def gated(decided: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds effect to decisions: ``edit``, ``red_mark`` or ``none``, and the suggestions the mark shows.

    With corrections off, or for other reasons than those applied, a correction is a
    mark that suggests the replacement; with spelling off there are no such marks.
    """
    corrects = F.col("action") == "auto_correct"
    allowed = F.lit(settings.autocorrect)
    if settings.applied_reasons:
        allowed = allowed & F.arrays_overlap("reason_codes", F.array(*[F.lit(r) for r in settings.applied_reasons]))
    marks = F.lit(settings.spellcheck) & (corrects | (F.col("action") == "mark_unresolved"))
    effect = F.when(corrects & allowed, "edit").when(marks, "red_mark").otherwise("none")
    blue = (F.col("effect") == "edit") & F.lit(settings.keep_marks)
    return decided.withColumn("effect", effect).withColumns({
        "shown_suggestions": F.when((F.col("effect") == "red_mark") & corrects, F.array("replacement")).when(F.col("effect") == "red_mark", F.col("suggestions")),
        "shown_mark": F.when(F.col("effect") == "red_mark", "red_spelling_issue").when(blue, "blue_applied_correction"),
    })


def numbered(marks: DataFrame, key: str = "doc_id", kind: str | None = None) -> DataFrame:
    """Marks (key, start, end, kind) in the order of their places, with n from 1; of one kind if named."""
    kept = marks if kind is None else marks.where(F.col("kind") == kind)
    priority = F.when(F.col("kind").startswith("blue"), 0).otherwise(1)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", priority)))


# What each user action is reported as.
RESULTS = {
    "revert_correction": "applied", "always_correct": "saved", "never_correct": "saved", "add_to_dictionary": "saved",
    "apply_suggestion": "applied", "ignore_once": "removed", "disable_autocorrect": "session",
}


def reported(actions: DataFrame) -> DataFrame:
    """User actions (type, original, replacement, word) as debug rows: action_type, original, replacement, result."""
    results = F.create_map(*[F.lit(x) for kv in RESULTS.items() for x in kv])
    word = F.when(F.col("type") == "add_to_dictionary", F.col("word")).when(F.col("type") == "disable_autocorrect", "").otherwise(F.col("original"))
    other = F.when(F.col("type").isin("add_to_dictionary", "ignore_once", "disable_autocorrect"), "").otherwise(F.col("replacement"))
    return actions.select(F.col("type").alias("action_type"), F.coalesce(word, F.lit("")).alias("original"), F.coalesce(other, F.lit("")).alias("replacement"), F.coalesce(F.try_element_at(results, F.col("type")), F.lit("session")).alias("result"))


def memory_log(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User actions with at (ms) as logs of own words and of rules."""
    words = actions.where("type = 'add_to_dictionary'").select("word", F.col("at").alias("created_at"))
    status = F.when(F.col("type") == "always_correct", "always").otherwise("never")
    rules = actions.where("type in ('always_correct', 'never_correct')").select("original", "replacement", status.alias("status"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return words, rules


def session_counts(decided: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Corrections, unknown words, skipped tokens and reverts of decided tokens (action, protected, and result of a revert if one was tried).

    Each row counts once, or as often as its column ``weight`` says.
    """
    tried = F.col("result") if "result" in decided.columns else F.lit("")
    n = F.lit(1) if weight is None else F.col(weight)
    count = lambda where: F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")
    return decided.groupBy(*by).agg(
        count((F.col("action") == "auto_correct") & ~F.col("protected")).alias("corrections"), count((F.col("action") == "mark_unresolved") & ~F.col("protected")).alias("unresolved"),
        count(F.col("protected")).alias("protected_skips"), count(tried == "reverted").alias("reverts"),
    )


__all__ = ["TRUSTED", "Settings", "gated", "memory_log", "numbered", "ready", "reported", "selection_dismissals", "session_counts", "still_shown", "trigger", "typed_delimiter"]
