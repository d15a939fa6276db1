"""URL filters: explicit host and path rules, then mined association rules.

Labelled pages give transactions of URL tokens plus a class item.  Spark's
FP-growth mines frequent combinations; rules that conclude the class ``block`` are
kept if confident and frequent enough and if no part of their tokens is as
confident.  Tokens that stand in exactly the same labelled pages (the parameters of a
repeated url) would multiply combinations that say the same; they are mined as
one, and any of them meets a rule that holds one.  A page is blocked if it meets all
tokens of a rule.  Matching goes through an inverted index: each rule stands under its
rarest token (and those mined with it) only, the page's tokens look it up, and the
rest of the rule is compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_enough, staged

#: Shares of the labelled pages that a combination needs, and of its pages that must be blocked.
SUPPORT = 0.002
CONFIDENCE = 0.6
#: Share of the pages with either of two tokens that hold both, from which on they are mined as one.
NEAR = 0.8
#: Bands of minimum hashes that propose such pairs, and hashes of a band: a pair at NEAR is missed once in three hundred.
BANDS, BAND = 8, 3
CLASS = "=block"
#: Most rules that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


PATH_RULES = (
    PathRule("block", "com", "/en/"),
    PathRule("allow", "example.com", "/en/7"),
    PathRule("allow", "net", "/de/"),
    PathRule("block", "example.net", "/de/8"),
    PathRule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    return ascii_lower(host), path


def fitting(host: Column, path: Column, rules: tuple[PathRule, ...]) -> Column:
    """The longest fitting rule as a struct (name, verdict), else null.  The few rules are part of the plan."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and host, path words, extension, query keys and pairs; runs of digits become one sign."""
    plain = lambda c: F.regexp_replace(ascii_lower(c), r"[0-9]+", "#")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))
    pairs = F.split(plain(query), "&")
    return F.array_distinct(
        F.concat(
            tag("s:", F.array(F.regexp_extract(ascii_lower(F.coalesce(url, F.lit(""))), r"\A([a-z][a-z0-9+.-]*)://", 1))),
            tag("h:", F.concat(F.array(host), F.split(host, r"\."))),
            tag("p:", F.split(plain(path), r"[/._-]+")),
            tag("q:", pairs),
            tag("k:", F.transform(pairs, lambda p: F.substring_index(p, "=", 1))),
        )
    )


def twins(rows: DataFrame, least: int) -> DataFrame:
    """(token, twin) for the tokens in at least ``least`` of ``rows`` (row, tokens): what each is mined as.

    A token is mined as the most frequent one with which it shares NEAR of the pages that
    hold either; the parameters of a link, of which most stand together and some are missing now and
    then, are thus one item.  Minimum hashes of a token's rows, in bands, propose the pairs, and counting
    confirms them.
    """
    marks = [F.min(F.xxhash64(F.lit(k), "row")).alias(f"least{k}") for k in range(BANDS * BAND)]
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("row").alias("n"), *marks).where(F.col("n") >= least)
    seen = staged(seen, "tokens")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), *[F.col(f"least{b * BAND + i}").alias(f"h{i}") for i in range(BAND)]) for b in range(BANDS)])
    banded = seen.select("token", "n", F.explode(bands).alias("band"))
    first = banded.groupBy("band").agg(F.min(F.struct((-F.col("n")).alias("order"), F.col("token").alias("leader"))).alias("first")).select("band", "first.leader", (-F.col("first.order")).alias("m"))
    pairs = staged(banded.join(first, "band").where(F.col("token") != F.col("leader")).select("token", "n", "leader", "m").distinct(), "pairs")
    met = rows.select("tokens", F.explode("tokens").alias("token")).join(pairs, "token").where(F.array_contains("tokens", F.col("leader"))).groupBy("token", "leader", "n", "m").agg(F.count("*").alias("both"))
    near = met.where(F.col("both") >= NEAR * (F.col("n") + F.col("m") - F.col("both")))
    led = staged(near.groupBy("token").agg(F.min(F.struct((-F.col("m")).alias("order"), "leader")).alias("best")).select("token", F.col("best.leader").alias("leader")), "led")
    # A leader that is led itself passes its own on.
    onward = led.select(F.col("token").alias("leader"), F.col("leader").alias("onward"))
    settled = led.join(onward, "leader", "left").select("token", F.coalesce("onward", "leader").alias("twin"))
    return staged(seen.select("token").join(settled, "token", "left").select("token", F.coalesce("twin", "token").alias("twin")), "twins")


RULE = "rule string, tokens array<string>, rarest string, confidence double, wanted array<array<string>>, filed array<string>"


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule, tokens, rarest, confidence, wanted, filed) from labelled pages (tokens, blocked).

    ``rule`` is the tokens joined by a space.  ``wanted`` has, for each token, those it was
    mined with, of which a page must hold one; ``filed`` those of the rarest token.
    Without a blocked page there is no rule.
    """
    spark = labelled.sparkSession
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "labelled")
    pages = rows.agg(F.count("row").alias("n"), F.count_if("blocked").alias("blocked")).first()
    if not pages["blocked"]:
        return spark.createDataFrame([], RULE)
    least = math.ceil(max(support * pages["n"], 2) - 1e-9)
    alike = twins(rows, least)
    # Frequent tokens number at most those of a page divided by the support, so Spark decides by their size how to join.
    merged = rows.select("row", "blocked", F.explode("tokens").alias("token")).join(alike, "token").groupBy("row", "blocked").agg(F.collect_set("twin").alias("items"))
    with_class = staged(merged.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(CLASS)))).otherwise(F.col("items")).alias("items")), "transactions")
    many = with_class.count()
    if not many:
        return spark.createDataFrame([], RULE)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / many, minConfidence=confidence).fit(with_class)
    sets = staged(model.freqItemsets, "itemsets")
    name = lambda c: F.array_join(F.array_sort(c), " ")
    ended = sets.where(F.array_contains("items", CLASS)).select(F.array_sort(F.array_remove("items", CLASS)).alias("tokens"), F.col("freq").alias("hits")).where(F.size("tokens") > 0)
    # The set without the class item is frequent too, so the join finds each rule's own frequency.
    rules = ended.select(name("tokens").alias("rule"), "tokens", "hits").join(sets.select(name("items").alias("rule"), "freq"), "rule").select("rule", "tokens", (F.col("hits") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= confidence)
    rules = staged(rules, "rules")
    # Prune rules that add tokens without adding confidence: compare with every rule one token shorter.
    shorter = rules.select("rule", "confidence", F.explode("tokens").alias("less"), "tokens").select("rule", "confidence", name(F.array_remove("tokens", F.col("less"))).alias("base"))
    beaten = shorter.join(rules.select(F.col("rule").alias("base"), F.col("confidence").alias("had")), "base").where("had >= confidence").select("rule").distinct()
    kept = rules.join(beaten, "rule", "left_anti")
    # How often each single token occurs settles where a rule is filed.
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    group = alike.groupBy(F.col("twin").alias("token")).agg(F.array_sort(F.collect_list("token")).alias("any"))
    each = kept.select("rule", "tokens", "confidence", F.explode("tokens").alias("token")).join(single, "token").join(group, "token")
    filed = each.groupBy("rule").agg(F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"), F.min(F.struct("freq", "token", "any")).alias("least"), F.array_sort(F.collect_list("any")).alias("wanted"))
    return staged(filed.select("rule", "tokens", F.col("least.token").alias("rarest"), "confidence", "wanted", F.col("least.any").alias("filed")), "rules")


def matches(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, mined): the most confident rule of each page that fits any; ties go to the first in order."""
    index = rules.select(F.explode("filed").alias("token"), "rule", "wanted", "confidence")
    index = F.broadcast(index) if small_enough(index, BROADCAST_RULES) else index
    looked = pages.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.forall("wanted", lambda any_: F.arrays_overlap(any_, F.col("tokens"))))
    return looked.groupBy(key).agg(F.min(F.struct((-F.col("confidence")).alias("order"), "rule")).alias("best")).select(key, F.col("best.rule").alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[PathRule, ...] = PATH_RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined for every row of ``pages`` (page_id, url).

    Labels (doc_id, quality) mark the pages of those ids; quality 0 means block, null
    none.  A page without tokens (null url) fits no rule and is allowed.  Rows that
    repeat a page_id are judged each by its url; a null page_id by path rules only.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    split = split.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    mined = mine(split.join(marks, "page_id").select("tokens", "blocked"), support, confidence)
    # Equal urls match equally: the url is the key, so a page repeated or hot costs one look-up.
    urls = split.where("url is not null").select("url", "tokens").dropDuplicates(["url"])
    found = matches(urls, mined, "url")
    chosen = fitting(F.col("host"), F.col("path"), rules)
    return split.drop("tokens").join(found, "url", "left").select("page_id", "host", "path", chosen["name"].alias("rule"), F.coalesce(chosen["verdict"], F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")
