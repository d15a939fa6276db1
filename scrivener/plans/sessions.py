"""Queries over snapshots of texts, corrections that race with edits, and answers that race with time limits, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import placed
from ..operators import editor, locking, markdown, marks, metrics, ranks, snapshots, tokens
from ..streaming import answers
from .correction import SQL_PLACED, read, user_edits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


#: Two characters that no text holds, so that only one alignment is longest.
INK, DOT = "\ue000", "\ue001"


def edited_turns(spark, sf_dir):
    """Four snapshots of each turn: as it is, without its letters z, with its letters k struck out, and with a mark behind every full stop."""
    less = F.replace("text", F.lit("z"), F.lit(""))
    struck = F.replace(less, F.lit("k"), F.lit(INK))
    dotted = F.replace(struck, F.lit("."), F.lit("." + DOT))
    versions = F.array(*[F.struct(F.lit(v).alias("version"), t.alias("text")) for v, t in enumerate((F.col("text"), less, struck, dotted))])
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("place"), F.explode(versions).alias("s"))
    return turns.select("place", "s.version", "s.text")


@query(rf"""WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[a-z]{{4,}}') AS ws, string_split_regex(text, '[a-z]{{4,}}') AS gaps FROM conversations),
u AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t),
p AS (SELECT conv_id, turn, text, ws[i] AS w, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda g: length(g))), 0) AS s FROM u),
m AS (SELECT *, CASE WHEN contains(w, 'z') THEN 1 WHEN contains(w, 'k') THEN 2 END AS lost, left(text, s::BIGINT) AS before FROM p),
q AS (SELECT *, s - CASE WHEN lost IS NULL OR lost = 2 THEN length(before) - length(replace(before, 'z', '')) ELSE 0 END + CASE WHEN lost IS NULL THEN length(before) - length(replace(before, '.', '')) ELSE 0 END AS place FROM m)
SELECT conv_id, turn, count(*) AS marks, count(*) FILTER (lost = 1) AS lost_1, count(*) FILTER (lost = 2) AS lost_2, sum(place)::BIGINT AS places, sum(length(w))::BIGINT AS sizes FROM q GROUP BY 1, 2""")
def marks_through_edits(spark, sf_dir):
    """Marks on the words of each turn through three edits of it: how many live, and where they are at last."""
    found = snapshots.scripts(edited_turns(spark, sf_dir), "place", "version")
    words = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("place"), F.explode(placed(F.col("text"), "[a-z]{4,}")).alias("w"))
    set_ = words.select("place", F.lit(0).alias("version"), F.col("w.start").alias("mark_start"), (F.col("w.start") + F.length("w.piece")).alias("mark_end"))
    lived = snapshots.carried(set_, found, "place", "version")
    return lived.groupBy("place.conv_id", "place.turn").agg(
        F.count("*").alias("marks"), F.count_if(F.col("lost_at") == 1).alias("lost_1"), F.count_if(F.col("lost_at") == 2).alias("lost_2"),
        F.sum("mark_start").alias("places"), F.sum(F.col("mark_end") - F.col("mark_start")).alias("sizes"),
    )


WORD = r"[a-z]{4,}"


def racing_corrections(spark, sf_dir):
    """Each conversation as a session whose text a turn replaces; then four corrections want to write a turn's first two words in capitals.

    The first saw the turn; the second saw it too, but comes after the first; the third saw
    what the first left; the fourth wants a word that is not at its place.
    """
    found = F.slice(F.filter(placed(F.col("text"), WORD), lambda w: w["piece"] != ""), 1, 2)
    turns = read(spark, sf_dir, "conversations").where("text is not null").withColumn("w", found)
    upper = F.regexp_replace("text", "^$", "")
    for k in (0, 1):
        w = F.get("w", F.lit(k))
        upper = F.when(w.isNotNull(), F.concat(F.substring(upper, F.lit(1), w["start"]), F.upper(w["piece"]), F.substring(upper, w["start"] + F.length(w["piece"]) + 1, F.length("text")))).otherwise(upper)
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("left_as", upper).withColumn("fresh", F.coalesce(F.col("text") != F.lag("left_as").over(order), F.lit(True)).cast("int"))
    before = F.coalesce(F.sum(F.col("fresh") + F.size("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("seen", (before + F.col("fresh")).cast("long"))
    fix = lambda n, k, seen: F.struct(F.lit(n).alias("n"), F.lit("correction").alias("kind"), seen.cast("long").alias("version"), F.get("w", F.lit(k))["start"].alias("start"), F.get("w", F.lit(k))["piece"].alias("original"))
    snap = F.struct(F.lit(0).alias("n"), F.lit("snapshot").alias("kind"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("original"))
    seen = F.col("seen")
    odd = F.struct(F.lit(4).alias("n"), F.lit("correction").alias("kind"), (seen + F.size("w")).alias("version"), F.lit(0).alias("start"), F.lit(INK).alias("original"))
    rows = turns.select("conv_id", "turn", "text", F.explode(F.array(snap, fix(1, 0, seen), fix(2, 1, seen), fix(3, 1, seen + 1), odd)).alias("e")).where("e.kind = 'snapshot' or e.original is not null")
    return rows.select(
        F.col("conv_id").alias("session"), (F.col("turn").cast("long") * 8 + F.col("e.n")).alias("seq"), "e.kind", F.when(F.col("e.kind") == "snapshot", F.col("text")).alias("text"), "e.version",
        F.length("text").alias("length"), "e.start", (F.col("e.start") + F.length("e.original")).alias("end"), "e.original", F.upper("e.original").alias("replacement"),
    )


@query(rf"""WITH t AS (SELECT conv_id AS session, turn, least(len(regexp_extract_all(text, '{WORD}')), 2) AS words FROM conversations WHERE text IS NOT NULL),
e AS (SELECT session, turn, unnest([1, 2, 3, 4]) AS n, words FROM t)
SELECT session, (turn * 8 + n)::BIGINT AS seq, CASE WHEN n = 4 OR n = 2 THEN 'stale' ELSE 'applied' END AS result FROM e WHERE n = 4 OR (n = 1 AND words > 0) OR (n > 1 AND n < 4 AND words > 1)""")
def locked_corrections(spark, sf_dir):
    """What becomes of corrections that race with each other for a session's text."""
    return locking.locked(racing_corrections(spark, sf_dir)).where("result <> 'lost'").select("session", "seq", "result")


#: Days within which a line of an order must ship to count as its answer.
DAYS = 60


def shipments(spark, sf_dir):
    """Orders as requests, and their lines as answers when they ship."""
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))
    got = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("received_at"))
    return asked, got


@query(f"""WITH j AS (SELECT o_orderkey AS request, o_orderdate AS sent, l_linenumber AS line, l_shipdate AS received FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {DAYS} DAY),
s AS (SELECT l_orderkey AS request, l_linenumber AS line FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {DAYS} DAY))
SELECT request, coalesce(line, 0) AS line, CASE WHEN received IS NULL THEN 'unanswered' ELSE 'answered' END AS result, coalesce(datediff('day', sent, received), -1)::BIGINT AS days FROM j UNION ALL SELECT request, line, 'stale', -1 FROM s""")
def answered_in_time(spark, sf_dir):
    """Orders with the lines that ship within the limit, orders without any, and lines that ship too early or too late."""
    asked, got = shipments(spark, sf_dir)
    found = answers.matched(asked, got, f"{DAYS} days")
    return found.select("request", F.coalesce("line", F.lit(0)).alias("line"), "result", F.coalesce(F.datediff("received_at", "sent_at"), F.lit(-1)).cast("long").alias("days"))


@query("""WITH v AS (SELECT l_returnflag AS flag, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'all', l_extendedprice FROM lineitem UNION ALL SELECT 'size', l_quantity FROM lineitem)
SELECT flag, p, CASE p WHEN 0.5 THEN quantile_disc(x, 0.5) WHEN 0.95 THEN quantile_disc(x, 0.95) ELSE quantile_disc(x, 0.99) END AS value FROM v, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) GROUP BY 1, 2""")
def exact_ranks(spark, sf_dir):
    """Nearest ranks of prices by return flag and of all lines, and of quantities, found by counting leading bits."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.explode(F.array(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x")), F.struct(F.lit("all").alias("flag"), F.col("l_extendedprice").alias("x")), F.struct(F.lit("size").alias("flag"), F.col("l_quantity").alias("x")))).alias("r")).select("r.*")
    return ranks.nearest(rows, "x", (0.5, 0.95, 0.99), "flag")


ODD = "\U0001f600"


@query(rf"""WITH t AS (SELECT conv_id, turn, replace(text, 'e', '{ODD}') AS text FROM conversations), c AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^ \n]+') AS ws, string_split_regex(text, '[^ \n]+') AS gaps FROM t),
u AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c),
p AS (SELECT conv_id, turn, ws[i] AS w, left(text, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda g: length(g))), 0))::BIGINT) AS a FROM u),
q AS (SELECT conv_id, turn, 2 * length(a) - length(replace(a, '{ODD}', '')) AS s, 2 * length(w) - length(replace(w, '{ODD}', '')) AS n FROM p)
SELECT conv_id, turn, count(*) AS words, sum(s)::BIGINT AS starts, sum(s + n)::BIGINT AS ends, true AS back FROM q GROUP BY 1, 2""")
def unit_offsets(spark, sf_dir):
    """Places of each turn's words in UTF-16 units, with a letter turned into an emoji, and whether they lead back."""
    odd = read(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("e"), F.lit(ODD))).withColumn("marks", units.astral(F.col("text")))
    words = odd.select("conv_id", "turn", "marks", F.explode(placed(F.col("text"), r"[^ \n]+")).alias("w")).select("conv_id", "turn", "marks", F.col("w.start").alias("a"), (F.col("w.start") + F.length("w.piece")).alias("z"))
    found = words.select("conv_id", "turn", "a", "z", units.units(F.col("a"), F.col("marks")).alias("start"), units.units(F.col("z"), F.col("marks")).alias("end"), "marks")
    back = (units.points(F.col("start"), F.col("marks")) == F.col("a")) & (units.points(F.col("end"), F.col("marks")) == F.col("z"))
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.bool_and(back).alias("back"))


@query("""WITH e AS (SELECT user_id AS session, event_id AS seq, event_type, floor(value)::BIGINT % 3 AS start, floor(value)::BIGINT % 3 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS finish FROM events),
k AS (SELECT *, CASE event_type WHEN 'click' THEN 'selection' WHEN 'view' THEN 'selection' WHEN 'error' THEN 'blur' ELSE 'input' END AS type FROM e),
l AS (SELECT *, last_value(CASE WHEN type <> 'blur' THEN start * 10 + finish END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM k),
r AS (SELECT CASE WHEN type = 'input' AND event_type = 'signup' THEN 'composition' WHEN type = 'input' AND start <> finish THEN 'selection_change' WHEN type = 'selection' AND known IS DISTINCT FROM start * 10 + finish THEN 'selection_change' WHEN type = 'blur' THEN 'blur' END AS reason FROM l)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def selection_news(spark, sf_dir):
    """Events read as inputs, selections and blurs of an editor: how often each tells a completion to go."""
    at = F.floor("value") % 3
    kind = F.when(F.col("event_type").isin("click", "view"), "selection").when(F.col("event_type") == "error", "blur").otherwise("input")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), F.lit(1).alias("version"), at.alias("start"), (at + (F.col("event_id") % 5 == 0).cast("int")).alias("end"), (F.col("event_type") == "signup").alias("composing"))
    return editor.selection_dismissals(rows, "session", "seq").groupBy("reason").agg(F.count("*").alias("n"))


@query(rf"""WITH {SQL_PLACED}, m AS (SELECT doc_id, start, end_, original, upper(replacement) AS suggestion, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM edits),
d AS (SELECT doc_id, text FROM documents), j AS (SELECT m.*, text, CASE WHEN n % 3 = 0 THEN 'missing_mark' WHEN n % 3 = 1 THEN 'applied' ELSE 'stale_range' END AS result FROM m JOIN d USING (doc_id))
SELECT doc_id, n::BIGINT AS mark_id, result, CASE WHEN result = 'applied' THEN start::INT ELSE -1 END AS start, CASE WHEN result = 'applied' THEN (start + length(suggestion))::INT ELSE -1 END AS new_end,
 CASE WHEN result = 'applied' THEN original ELSE '' END AS original, CASE WHEN result = 'applied' THEN suggestion ELSE '' END AS replacement, md5(CASE WHEN result = 'applied' THEN left(text, start::BIGINT) || suggestion || substr(text, end_::BIGINT + 1) ELSE text END) AS text_md5 FROM j""")
def popover_suggestions(spark, sf_dir):
    """A suggestion taken at each place of a correction: every third mark is gone, and every third stands a character off."""
    edited = user_edits(spark, sf_dir)
    third = F.col("n") % 3
    off = (third == 2).cast("int")
    kept = edited.where(third != 0).select("doc_id", F.col("n").cast("long").alias("mark_id"), (F.col("start") + off).alias("mark_start"), (F.col("end") + off).alias("mark_end"), F.col("original").alias("mark_text"), "original", "reason_codes")
    chosen = edited.select("doc_id", F.col("n").cast("long").alias("mark_id"), F.upper("replacement").alias("suggestion"))
    found = marks.suggested(read(spark, sf_dir, "documents"), kept, chosen)
    number, word = (lambda c: F.coalesce(c, F.lit(-1)).alias(c)), (lambda c: F.coalesce(c, F.lit("")).alias(c))
    return found.select("doc_id", "mark_id", "result", number("start"), number("new_end"), word("original"), word("replacement"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"""WITH {SQL_PLACED}, m AS (SELECT doc_id, start::INT AS start, end_::INT AS "end", 'blue_applied_correction' AS kind FROM edits UNION ALL SELECT doc_id, start::INT, end_::INT, 'red_spelling_issue' FROM edits WHERE start % 2 = 0)
SELECT doc_id, start, "end", kind, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", kind)::INT AS n FROM m""")
def numbered_marks(spark, sf_dir):
    """The marks of each document by their order; at every second place a red one stands under the blue one."""
    blue = user_edits(spark, sf_dir).select("doc_id", "start", "end", F.lit("blue_applied_correction").alias("kind"))
    red = blue.where(F.col("start") % 2 == 0).withColumn("kind", F.lit("red_spelling_issue"))
    return editor.numbered(red.unionByName(blue))


SQL_SURVIVES = "SELECT conv_id, turn, left(text, 5) AS original, left(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 5) AS now FROM conversations"


@query(f"""WITH f AS ({SQL_SURVIVES}), g AS (SELECT * FROM f WHERE now IS NOT NULL AND length(original) = 5)
SELECT conv_id, count(*) FILTER (now = original) AS same, count(*) FILTER (CASE WHEN turn % 2 = 0 THEN length(now) = 5 ELSE now = original END) AS decorated, count(*) FILTER (turn % 3 > 0) AS current FROM g GROUP BY 1""")
def marks_that_survive(spark, sf_dir):
    """Marks on the first five characters of each turn when the next takes its place: by text, as decorations, and by version."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("place"), "turn", "text", after.alias("next")).where("next is not null and length(text) >= 5")
    kind = F.when(F.col("turn") % 2 == 0, "blue_applied_correction").otherwise("red_spelling_issue").alias("kind")
    set_ = turns.select("place", F.lit(0).alias("mark_start"), F.lit(5).alias("mark_end"), F.left("text", F.lit(5)).alias("original"), F.left("next", F.lit(5)).alias("replacement"), kind, F.lit(1).alias("version"))
    now = turns.select("place", F.col("next").alias("text"), F.when(F.col("turn") % 3 > 0, 1).otherwise(2).alias("version"))
    kept = None
    for name, policy in (("same", "same_offset"), ("decorated", "decoration"), ("current", "version")):
        found = marks.surviving(set_, now, policy, "place").select("place", F.lit(name).alias("policy"))
        kept = found if kept is None else kept.unionByName(found)
    every = turns.select("place", F.lit("all").alias("policy"))
    return every.unionByName(kept).groupBy("place.conv_id").agg(*[F.count_if(F.col("policy") == n).alias(n) for n in ("same", "decorated", "current")])


ACTIONS = {"click": "apply_suggestion", "view": "ignore_once", "purchase": "always_correct", "error": "disable_autocorrect", "signup": "add_to_dictionary"}


@query(f"""WITH a AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END AS action_type, props FROM events)
SELECT action_type, CASE action_type WHEN 'disable_autocorrect' THEN '' WHEN 'add_to_dictionary' THEN upper(props) ELSE props END AS original, CASE WHEN action_type IN ('apply_suggestion', 'always_correct') THEN lower(props) || '!' ELSE '' END AS replacement,
 CASE action_type WHEN 'apply_suggestion' THEN 'applied' WHEN 'ignore_once' THEN 'removed' WHEN 'disable_autocorrect' THEN 'session' ELSE 'saved' END AS result, count(*) AS n FROM a WHERE props IS NOT NULL GROUP BY ALL""")
def action_reports(spark, sf_dir):
    """The event table read as user actions: what is reported of each."""
    kinds = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    acts = read(spark, sf_dir, "events").where("props is not null").select(kinds[F.col("event_type")].alias("type"), F.col("props").alias("original"), F.concat(F.lower("props"), F.lit("!")).alias("replacement"), F.upper("props").alias("word"))
    return editor.reported(acts).groupBy("action_type", "original", "replacement", "result").agg(F.count("*").alias("n"))


LEGS = {"click": "request_scheduled", "view": "request_sent", "purchase": "response_received", "error": "ghost_shown", "signup": "ghost_accepted"}


@query("""WITH f AS (SELECT user_id AS request_id, min(epoch_us(ts) // 1000) FILTER (event_type = 'click') AS i, min(epoch_us(ts) // 1000) FILTER (event_type = 'view') AS s, min(epoch_us(ts) // 1000) FILTER (event_type = 'purchase') AS r,
 min(epoch_us(ts) // 1000) FILTER (event_type = 'error') AS g, min(epoch_us(ts) // 1000) FILTER (event_type = 'signup') AS a FROM events GROUP BY 1)
SELECT request_id, coalesce(s - i, 0) AS input_to_request_ms, coalesce(r - s, 0) AS request_to_response_ms, coalesce(g - i, 0) AS input_to_ghost_ms, coalesce(a - g, 0) AS ghost_to_action_ms FROM f""")
def request_times(spark, sf_dir):
    """The legs of a request, from each user's first events of every kind; nought where one is missing."""
    kinds = F.create_map(*[F.lit(x) for kv in LEGS.items() for x in kv])
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), kinds[F.col("event_type")].alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return metrics.request_timings(rows).fillna(0)


def syntax_tokens(spark, sf_dir):
    """Tokens of each turn that the Markdown structure protects, and those that its lines protect.

    SQL has no such parse; the tests compare the spans with a plain reader's.
    """
    turns = markdown.with_spans(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    found = tokens.placed_tokens(turns, "conv_id", "turn", "syntax")
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("tokens"), F.count_if(markdown.protected(F.col("syntax"), F.col("start"), F.col("end"))).alias("protected"))


def page_syntax(spark, sf_dir):
    """Spans of each page read as Markdown, by kind: pages hold HTML blocks, tags, code and addresses."""
    spans = markdown.with_spans(read(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", F.explode("syntax").alias("s"))
    return spans.groupBy("page_id", "s.kind").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("size"))


QUERIES |= {f.__name__: f for f in (syntax_tokens, page_syntax)}
