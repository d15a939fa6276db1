"""What to do about a token: leave it, correct it, or mark it.

Decisions depend on the token alone, so they are made once for each distinct
token.  Cheap tests come first, and only what they leave open reaches the fuzzy
join with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reasons import BIT, codes
from ..functions.text import token_key
from ..sources.vocabulary import TYPO_CONFIDENCE, known_words, typos

DISTANCE, LONGEST, CANDIDATES, SUGGESTIONS = 2, 64, 256, 4
#: Characters that a suggestion and a replacement may have; longer ones are cut.
SLOT, REPLACEMENT = 31, 127
#: Vocabularies up to this size are compared word by word with each token; larger ones through deletions.
SCANNED = 64


def vocabulary(spark, dictionary: DataFrame | None = None) -> DataFrame:
    """Loaded words, then the built-in ones they do not hold: (source, load_order, word, frequency)."""
    built_in = known_words(spark).select(F.lit(1).alias("source"), "load_order", "word", "frequency")
    if dictionary is None:
        return built_in
    loaded = dictionary.select(F.lit(0).alias("source"), "load_order", "word", "frequency")
    return loaded.unionByName(built_in.join(F.broadcast(loaded), "word", "left_anti"))


def deletions(word: Column) -> Column:
    """A word and all that one or two deletions leave of it, each once."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(word), once(word), F.flatten(F.transform(once(word), once))))


def fuzzy_pairs(tokens: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Tokens (distinct, column token) with the words (column word and others) within edit distance two, themselves excluded.

    ``size`` bounds the words, which are broadcast.  Few words: a join on the length
    band.  Many: words and tokens that have a deletion in common, which any two
    within the distance do; both are checked by the distance itself.
    """
    token, word = F.col("token"), F.col("word")
    distance = F.levenshtein(token, word, DISTANCE)
    close = (word != token) & (F.length(token) <= LONGEST) & (F.length(word) <= LONGEST)
    if size <= SCANNED:
        pairs = tokens.join(F.broadcast(words), close & (F.abs(F.length(token) - F.length(word)) <= DISTANCE) & (distance >= 0))
    else:
        filed = words.select("*", F.explode(deletions(word)).alias("form"))
        asked = tokens.where(F.length(token) <= LONGEST).select("token", F.explode(deletions(token)).alias("form"))
        pairs = asked.join(F.broadcast(filed), "form").where(close & (distance >= 0)).drop("form").distinct()
    return pairs.withColumn("distance", distance)


def suggestions(tokens: DataFrame, words: DataFrame, size: int, most: int = SUGGESTIONS) -> DataFrame:
    """Ranked suggestions (token, rank, word, distance, score, truncated) for distinct lower-case tokens.

    Of a token's candidates the first CANDIDATES in load order count; they rank by
    distance, then frequency, then alphabet; ``most`` is held within 1 to 8.
    """
    pairs = fuzzy_pairs(tokens.where(F.col("token").rlike(r"\A[a-z]+\z")), words, size)
    loaded = Window.partitionBy("token").orderBy("source", "load_order", "word")
    ranked = Window.partitionBy("token").orderBy("distance", F.desc("frequency"), "word")
    score = (3 - F.col("distance")) * 2.0 + F.least(F.col("frequency"), F.lit(1_000_000)) / 1_000_000
    capped = pairs.withColumn("place", F.row_number().over(loaded)).where(F.col("place") <= CANDIDATES)
    return (
        capped.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= max(1, min(8, most)))
        .select("token", "rank", F.substring("word", 1, SLOT).alias("word"), "distance", score.alias("score"), (F.length("word") > SLOT).alias("truncated"))
    )


def checked(tokens: DataFrame, dictionary: DataFrame | None = None, size: int = 4096) -> DataFrame:
    """Engine decision for each distinct token: token, code, replacement, confidence, flags, suggestions.

    Code 0 leaves a token, 1 corrects it, 2 marks it as unknown.  ``size`` bounds the dictionary.
    """
    spark = tokens.sparkSession
    distinct = tokens.select("token").distinct()
    built_in = known_words(spark).select(F.col("word").alias("token"), F.lit(True).alias("known"))
    found = distinct.join(F.broadcast(built_in), "token", "left").join(F.broadcast(typos(spark).withColumnRenamed("typo", "token")), "token", "left")
    if dictionary is None:
        found = found.withColumn("dynamic", F.lit(False))
        words, size = vocabulary(spark), SCANNED
    else:
        loaded = dictionary.where(F.col("word").rlike(r"\A[a-z]+\z")).select(F.col("word").alias("token"), F.lit(True).alias("dynamic"))
        found = found.join(F.broadcast(loaded), "token", "left").withColumn("dynamic", F.coalesce("dynamic", F.lit(False)))
        words, size = vocabulary(spark, dictionary), size + SCANNED
    lower = F.col("token").rlike(r"\A[a-z]+\z")
    of = lambda code, name: F.struct(F.lit(code).alias("code"), F.lit(BIT[name]).alias("flags"))
    kind = (
        F.when(F.col("token") == "", of(0, "INVALID_INPUT"))
        .when(F.col("dynamic"), of(0, "DYNAMIC_DICTIONARY_MATCH"))
        .when(F.col("known"), of(0, "KNOWN_VALID_WORD"))
        .when(~lower, of(0, "PROTECTED_LOOKING_TOKEN"))
        .when(F.col("replacement").isNotNull(), of(1, "COMMON_TYPO_MATCH"))
        .otherwise(of(2, "UNKNOWN_NON_WORD"))
    )
    found = found.withColumn("kind", kind).select("token", "replacement", "kind.code", "kind.flags")
    # Corrections get suggestions too: a rule against one turns it into a mark.
    asked = found.where("code in (1, 2)").select("token")
    ranked = suggestions(asked, words, size).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ranked"), F.max("truncated").alias("truncated"))
    none = F.expr("cast(array() as array<string>)")
    words_ = F.coalesce(F.transform("ranked", lambda r: r["word"]), none)
    longer = F.when(F.when(F.col("code") == 1, F.length("replacement") > REPLACEMENT).otherwise(F.coalesce("truncated", F.lit(False)) & (F.col("code") == 2)), BIT["REPLACEMENT_TRUNCATED"]).otherwise(0)
    more = F.when(F.col("code") != 2, 0).when(F.col("ranked").isNotNull(), BIT["EDIT_DISTANCE_SUGGESTIONS"]).otherwise(BIT["NO_SUGGESTIONS"])
    return found.join(ranked, "token", "left").select(
        "token", "code", F.when(F.col("code") == 1, F.substring("replacement", 1, REPLACEMENT)).alias("replacement"),
        F.when(F.col("code") == 1, F.lit(TYPO_CONFIDENCE)).alias("confidence"),
        F.col("flags").bitwiseOR(more).bitwiseOR(longer).alias("flags"), words_.alias("suggestions"),
    )


def decisions(tokens: DataFrame, dictionary: DataFrame | None = None, personal: DataFrame | None = None, rules: DataFrame | None = None, language: str = "en-US", size: int = 4096) -> DataFrame:
    """Final decision for each distinct token: token, action, replacement, confidence, suggestions, mark, reason_codes.

    The user's own words come first, then rules to correct always, then the engine;
    rules never to correct turn a correction into a mark that suggests it.
    """
    none = F.expr("cast(array() as array<string>)")
    if language != "en-US":
        null = F.lit(None)
        return tokens.select("token").distinct().select("token", F.lit("do_nothing").alias("action"), null.cast("string").alias("replacement"), null.cast("double").alias("confidence"), none.alias("suggestions"), null.cast("string").alias("mark"), F.array(F.lit("UNSUPPORTED_LANGUAGE")).alias("reason_codes"))
    spark = tokens.sparkSession
    found = checked(tokens, dictionary, size).withColumn("key", token_key(F.col("token")))
    if personal is None:
        personal = spark.createDataFrame([], "word string")
    if rules is None:
        rules = spark.createDataFrame([], "original string, replacement string, status string, updated_at long")
    own = personal.select(token_key(F.col("word")).alias("key"), F.lit(True).alias("own")).distinct()
    latest = Window.partitionBy("key").orderBy(F.desc("updated_at"), "always")
    always = rules.where("status = 'always'").select(token_key(F.col("original")).alias("key"), F.col("replacement").alias("always"), "updated_at").withColumn("n", F.row_number().over(latest)).where("n = 1").select("key", "always")
    never = rules.where("status = 'never'").select(token_key(F.col("original")).alias("key"), F.col("replacement"), F.lit(True).alias("never")).distinct()
    # The user's own entries are a handful typed by hand; the optimizer broadcasts them by their size.
    found = found.join(own, "key", "left").join(always, "key", "left").join(never, ["key", "replacement"], "left")
    case = (
        F.when(F.col("token") == "", "none").when(F.col("own"), "own").when(F.col("always").isNotNull(), "always")
        .when((F.col("code") == 1) & F.col("never"), "never").when(F.col("code") == 1, "typo").when(F.col("code") == 2, "unknown").otherwise("none")
    )
    c = F.col("case")
    engine = codes(F.col("flags"))
    return found.withColumn("case", case).select(
        "token",
        F.when(c.isin("always", "typo"), "auto_correct").when(c.isin("never", "unknown"), "mark_unresolved").otherwise("do_nothing").alias("action"),
        F.when(c == "always", F.col("always")).when(c == "typo", F.col("replacement")).alias("replacement"),
        F.when(c == "always", 1.0).when(c == "typo", F.col("confidence")).alias("confidence"),
        F.when(c == "never", F.concat(F.array("replacement"), F.array_remove("suggestions", F.col("replacement")))).when(c == "unknown", F.col("suggestions")).otherwise(none).alias("suggestions"),
        F.when(c.isin("always", "typo"), "blue_applied_correction").when(c.isin("never", "unknown"), "red_spelling_issue").alias("mark"),
        F.when(c == "own", F.array(F.lit("PERSONAL_DICTIONARY_MATCH"))).when(c == "always", F.array(F.lit("ALWAYS_CORRECT_RULE")))
        .when(c == "never", F.concat(engine, F.array(F.lit("NEVER_CORRECT_RULE")))).otherwise(engine).alias("reason_codes"),
    )
