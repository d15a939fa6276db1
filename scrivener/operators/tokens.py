"""Completed tokens of texts.

A token is a run without spaces, commas, brackets and the like, less the stops and
colons at its end; it is complete if a closing character follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DELIMITERS, SPACES, is_delimiter, let, placed, running, token_type

#: A token and what closes it.  The atomic group takes a whole run up to its last character other
#: than stops and colons, so a run that is not closed cannot match in part.
COMPLETE = r"((?>[^ \n\t,!?;()\[\]{}]*[^ \n\t,!?;()\[\]{}.:]))(?:[.:]+|(?=[ \n\t,!?;)\]}]))"
RUN = r"[^ \n\t,!?;()\[\]{}]+"


def only(tokens: list[str]) -> str:
    """A pattern that matches where COMPLETE does, but only at these tokens; group 1 is the token."""
    listed = "|".join("".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in t) for t in sorted(tokens, key=len, reverse=True))
    return r"(?<![^ \n\t,!?;()\[\]{}])(" + listed + r")(?:[.:]++(?![^ \n\t,!?;()\[\]{}])|(?=[ \n\t,!?;)\]}]))"


def final_tokens(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row for each completed token: the columns ``keep``, and token.  Nothing is shuffled."""
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(COMPLETE), F.lit(1))).alias("token"))


def placed_runs(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The runs of each row with their start, in code points: the columns ``keep``, run and start.  Nothing is shuffled."""
    return docs.select(*keep, F.explode(placed(F.col(text), RUN)).alias("at")).select(*keep, F.col("at.piece").alias("run"), "at.start")


def placed_tokens(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """As :func:`final_tokens`, with the tokens' start and end, in code points."""
    found = docs.select(*keep, F.explode(placed(F.col(text), COMPLETE, 1)).alias("at")).select(*keep, F.col("at.piece").alias("token"), "at.start")
    return found.withColumn("end", F.col("start") + F.length("token"))


#: Closing characters; those that are no stop or colon also end a run, and one of SPACES or OPENERS is all else that does.
CLOSERS, ENDS, OPENERS = r".,!?;:)\]}", r",!?;)\]}", r"(\[{"
#: A character of a run.  Those of one byte are listed, which Java looks up before it tries the ranges of others.
INNER = "[[" + "".join(rf"\x{n:02X}" for n in range(256) if chr(n) not in " \t\n\x0B\f\r\xA0,!?;()[]{}") + rf"][^\x00-\xFF{SPACES}]]"
#: A run (group 1), what closes it, spaces, and openers: the parts that a text is cut into, without a gap.  Stops and
#: colons behind a closing character belong to it, but to the next run if they touch one.
PART = rf"(?s)(?=.)({INNER}++)?+(?:[{ENDS}](?>[{CLOSERS}]*+(?!{INNER})|[{CLOSERS}]*(?<![.:])))?+[{SPACES}]*+[{OPENERS}]*+"


def replayed_tokens(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row for each delimiter as it is typed: its offset and the token before it (null if none).

    The text is cut once.  All delimiters behind a run complete it, those inside it what
    stands before them, and stops and colons at its beginning complete the run before, if
    that and its closing characters touch them.
    """
    col = lambda c: F.col(f"at.{c}")
    at = lambda *columns: F.struct(*columns).alias("at")
    stop = lambda r: r.contains(".") | r.contains(":")
    stripped = lambda r: F.when(r.endswith(".") | r.endswith(":"), F.regexp_replace(r, r"(?<![.:])[.:]+\z", "")).otherwise(r)
    matched = lambda group: F.regexp_extract_all(F.col(text), F.lit(PART), F.lit(group))

    def parts(pieces: Column) -> Column:
        size = F.transform(pieces, F.length)
        # Only a run that begins with a stop looks back.
        ended = lambda piece: F.when(piece.rlike(rf"[{ENDS}]\z"), F.regexp_extract(piece, rf"\A{INNER}+", 0))
        before = lambda run, i: F.when(run.startswith(".") | run.startswith(":"), F.struct(ended(F.get(pieces, i - 1)).alias("run"), F.length(F.get(pieces, i - 1)).alias("size")))
        zipped = F.arrays_zip(pieces.alias("piece"), matched(1).alias("run"), running(size).alias("end"), size.alias("size"))
        return F.transform(zipped, lambda z, i: F.struct(z["run"].alias("run"), F.substring(z["piece"], F.length(z["run"]) + 1, z["size"]).alias("rest"), (z["end"] - z["size"]).cast("int").alias("from"), before(z["run"], i).alias("before")))

    cut = docs.select(*keep, F.explode(let(matched(0), parts)).alias("at"))
    cut = cut.select(*keep, at(col("run"), col("rest"), col("from"), col("before"), F.length(col("run")).alias("all"), F.length(stripped(col("run"))).alias("whole"), F.translate(col("rest"), DELIMITERS, "").alias("others")))
    # Places of delimiters in the part: those of the run, and those behind it, mostly a row up to the openers.
    places = lambda string, skipped: F.filter(F.transform(F.split(string, ""), lambda c, i: F.when(is_delimiter(c), skipped + i + 1)), lambda n: n.isNotNull())
    many = F.length(col("rest")) - F.length(col("others"))
    plain = F.when(many > 0, F.sequence(col("all") + 1, col("all") + many)).otherwise(F.expr("cast(array() as array<int>)"))
    behind = F.when(F.translate(col("others"), "([{", "") == "", plain).otherwise(places(col("rest"), col("all")))
    spots = F.when(stop(col("run")), F.concat(places(col("run"), F.lit(0)), behind)).otherwise(behind)
    # Tokens are made of the places one by one: an array of them would hold a long run many times.
    found = cut.select(*keep, at(col("run"), col("from"), col("before"), col("all"), col("whole")), spots.alias("spots"))
    # A plain explode would filter by the arrays first, and make each three times.
    found = found.select(*keep, "at", F.explode_outer("spots").alias("place")).where("place is not null")
    place, touched = F.col("place"), stripped(col("before.run"))
    size = F.when(place > col("all"), col("whole")).otherwise(F.length(stripped(F.substring(col("run"), F.lit(1), place))))
    found = found.select(*keep, at(col("run"), col("from"), col("before"), size.alias("size"), (col("from") + place).alias("offset")))
    own = col("size") > 0
    token = F.when(own, F.substring(col("run"), F.lit(1), col("size"))).when(touched != "", touched)
    start = F.when(own, col("from")).when(touched != "", col("from") - col("before.size"))
    found = found.select(*keep, at(col("offset"), token.alias("token"), start.alias("start")))
    return found.select(*keep, col("offset"), col("token"), col("start"), (col("start") + F.length(col("token"))).alias("end"))


def classified(found: DataFrame, token: str = "token") -> DataFrame:
    """Adds token_type and protected."""
    return found.withColumn("token_type", token_type(F.col(token))).withColumn("protected", F.col("token_type") != "word")


def unprotected(found: DataFrame, where: Column, token: str = "token") -> DataFrame:
    """Rows with an unprotected token.

    ``where``, true for every row, names a column that an aggregate or join below
    makes: the classes are then tested on its few rows, not pushed down to all tokens.
    """
    return found.where(F.when(where, token_type(F.col(token)) == "word"))
