"""Built-in words and typos, and dictionaries that are loaded over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
KNOWN_WORDS = (
    "the", "and", "receipt", "recipe", "receive", "address", "spelling", "correction", "correct", "because",
    "their", "there", "form", "from", "lead", "led", "to", "too", "its", "it's", "hello", "world", "typing",
    "test", "message", "prompt", "code", "this", "is", "a", "simple", "word", "user", "home", "nmap", "sqlmap", "cve",
)
TYPOS = (("teh", "the"), ("adn", "and"), ("recieve", "receive"), ("becuase", "because"), ("thier", "their"))
TYPO_CONFIDENCE = 0.99
#: Limits of a loaded dictionary.
WORDS, TABLE_BYTES = 4096, 65_536

SCHEMA = "load_order int, word string, frequency long, flags long"


def known_words(spark: SparkSession) -> DataFrame:
    """Built-in words in their order; frequency and flags are 0."""
    return spark.createDataFrame([(k, w, 0, 0) for k, w in enumerate(KNOWN_WORDS)], SCHEMA)


def typos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPOS), "typo string, replacement string")


def corpus_dictionary(docs: DataFrame, labels: DataFrame, words: int = WORDS, shortest: int = 2) -> DataFrame:
    """A dictionary of the commonest lower-case words of good documents, in ascending order of the words.

    Words are counted before anything is ranked, so the ranking sees one row a word;
    its top is a bounded sort on each task, then one over those.
    """
    from ..operators.tokens import final_tokens

    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    counts = final_tokens(good, "doc_id").where(F.col("token").rlike(rf"\A[a-z]{{{shortest},}}\z")).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("frequency"))
    top = counts.orderBy(F.desc("frequency"), "word").limit(words)
    place = F.row_number().over(Window.orderBy("word")) - 1  # at most WORDS rows
    return top.select(place.cast("int").alias("load_order"), "word", "frequency", F.lit(0).cast("long").alias("flags"))
