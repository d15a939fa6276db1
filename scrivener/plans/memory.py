"""Queries over a user's memory and over what editors do, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import completion, spans
from ..functions.text import rule_key, visible
from ..operators import decide, editor, marks, metrics, protect, requests, rules, tokens
from ..sources import vocabulary
from ..streaming import keystrokes
from .correction import ORACLES as CORRECTION_ORACLES
from .correction import RUN, SQL_KNOWN, SQL_PLACED, SQL_TOKENS, SQL_TYPE, SQL_TYPO, metric_events, read, user_edits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


SQL_TALK = rf"""talk AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{RUN}[ \n\t,!?;)\]}}]?')) AS piece FROM conversations),
talk2 AS (SELECT *, regexp_replace(piece, '[ \n\t,!?;)\]}}]\z', '') AS run FROM talk), talk3 AS (SELECT *, regexp_replace(run, '[.:]+\z', '') AS token FROM talk2),
said AS (SELECT token, min(turn) AS first, max(turn) AS last FROM talk3 WHERE (piece <> run OR token <> run) AND regexp_matches(token, '\A[a-z]{{3,}}\z') GROUP BY 1),
log AS (SELECT token AS original, upper(token) AS replacement, CASE WHEN token < 'n' THEN 'never' ELSE 'always' END AS status, first AS created_at, last AS updated_at FROM said
 UNION ALL SELECT token, replacement, CASE WHEN token < 'n' THEN 'never' ELSE 'always' END, 0, 0 FROM typo)"""


def talked_rules(spark, sf_dir):
    """A rule for each word of conversations and each typo: never to correct those before the letter n, always the others."""
    said = tokens.final_tokens(read(spark, sf_dir, "conversations"), "turn").where(F.col("token").rlike(r"\A[a-z]{3,}\z"))
    said = said.groupBy("token").agg(F.min("turn").cast("long").alias("created_at"), F.max("turn").cast("long").alias("updated_at"))
    nought = F.lit(0).cast("long")
    typos = vocabulary.typos(spark).select(F.col("typo").alias("original"), "replacement", nought.alias("created_at"), nought.alias("updated_at"))
    both = said.select(F.col("token").alias("original"), F.upper("token").alias("replacement"), "created_at", "updated_at").unionByName(typos)
    return both.select("original", "replacement", F.when(F.col("original") < "n", "never").otherwise("always").alias("status"), "created_at", "updated_at")


@query(rf"""WITH {SQL_TOKENS}, {SQL_KNOWN}, {SQL_TYPO}, {SQL_TALK}, typed AS (SELECT DISTINCT token, token AS t FROM tok), asked AS (SELECT token FROM typed WHERE {SQL_TYPE} = 'word' UNION SELECT token FROM typo),
rated AS (SELECT a.token, t.replacement AS fix, l.token IS NOT NULL AS always, k.word IS NOT NULL AS known, n.original IS NOT NULL AS never FROM asked a LEFT JOIN typo t USING (token) LEFT JOIN (SELECT DISTINCT original AS token FROM log WHERE status = 'always') l USING (token)
 LEFT JOIN known k ON a.token = k.word LEFT JOIN (SELECT DISTINCT original, replacement FROM log WHERE status = 'never') n ON a.token = n.original AND t.replacement = n.replacement),
cases AS (SELECT *, CASE WHEN always THEN 'ALWAYS_CORRECT_RULE' WHEN known THEN 'KNOWN_VALID_WORD' WHEN NOT regexp_matches(token, '\A[a-z]+\z') THEN 'PROTECTED_LOOKING_TOKEN' WHEN fix IS NOT NULL THEN 'COMMON_TYPO_MATCH' ELSE 'UNKNOWN_NON_WORD' END AS reason FROM rated),
acts AS (SELECT token, fix, reason, never AND reason = 'COMMON_TYPO_MATCH' AS never FROM cases)
SELECT CASE WHEN reason = 'UNKNOWN_NON_WORD' OR never THEN 'mark_unresolved' WHEN reason IN ('ALWAYS_CORRECT_RULE', 'COMMON_TYPO_MATCH') THEN 'auto_correct' ELSE 'do_nothing' END AS action,
 reason, never, count(*) AS n, coalesce(string_agg(fix, ',' ORDER BY token) FILTER (never), '') AS suggested FROM acts GROUP BY 1, 2, 3""")
def never_rules(spark, sf_dir):
    """Decisions under a large memory: rules never to correct turn corrections into marks that suggest them first."""
    found = tokens.final_tokens(read(spark, sf_dir, "documents")).groupBy("token").count()
    asked = tokens.unprotected(found, F.col("count") > 0).select("token").union(vocabulary.typos(spark).select("typo"))
    decided = decide.decisions(asked, rules=rules.latest_rules(talked_rules(spark, sf_dir)))
    decided = decided.withColumn("never", F.array_contains("reason_codes", "NEVER_CORRECT_RULE"))
    first = F.get("suggestions", F.lit(0)).alias("first")
    marked = F.array_sort(F.collect_list(F.when(F.col("never"), F.struct("token", first))))  # at most the built-in typos
    grouped = decided.groupBy("action", F.col("reason_codes")[0].alias("reason"), "never").agg(F.count("*").alias("n"), marked.alias("marked"))
    return grouped.select("action", "reason", "never", "n", F.array_join(F.transform("marked", lambda m: m["first"]), ",").alias("suggested"))


def nation_memory(spark, sf_dir):
    """A user's memory from two tables of fixed size: nations as own words, and a rule from each to its region."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.col("n_nationkey").cast("long")
    status = F.when(F.col("r_regionkey") < 2, "always").otherwise("never").alias("status")
    log = nations.select(F.col("n_name").alias("original"), F.col("r_name").alias("replacement"), status, at.alias("created_at"), (at + 100).alias("updated_at"))
    return rules.own_words(nations.select(F.col("n_name").alias("word"), at.alias("created_at"))), rules.latest_rules(log)


SQL_MEMORY = """memory AS (SELECT lower(trim(n_name)) AS original, r_name AS replacement, CASE WHEN r_regionkey < 2 THEN 'always' ELSE 'never' END AS status,
 CAST(n_nationkey AS BIGINT) AS created_at, CAST(n_nationkey + 100 AS BIGINT) AS updated_at FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {SQL_MEMORY} SELECT 'personal_dictionary' AS namespace, count(DISTINCT original) AS entries FROM memory UNION ALL SELECT 'correction_rules', count(*) FROM memory")
def memory_counts(spark, sf_dir):
    words, log = nation_memory(spark, sf_dir)
    return rules.memory_counts({"personal_dictionary": words, "correction_rules": log})


@query(f"""WITH {SQL_MEMORY} SELECT *, 'correction_rules' AS part FROM memory UNION ALL SELECT original, '', '', created_at, 0, 'personal_dictionary' FROM memory
 UNION ALL SELECT lower(r_name), CASE WHEN r_regionkey = 1 THEN 'true' ELSE CAST(r_regionkey AS VARCHAR) END, '', 0, 0, 'settings' FROM region UNION ALL SELECT 'kept', '7', '', 0, 0, 'settings'""")
def memory_export(spark, sf_dir):
    """What an import brings back of an export, merged into a memory with a setting that stays and one that is replaced."""
    regions = read(spark, sf_dir, "region").select(F.lower("r_name").alias("key"), F.when(F.col("r_regionkey") == 1, "true").otherwise(F.col("r_regionkey").cast("string")).alias("value"))
    documents = rules.exported(*nation_memory(spark, sf_dir), "2024-01-01T00:00:00.000Z", regions)
    empty = rules.Memory(spark.createDataFrame([], rules.WORDS), spark.createDataFrame([], rules.RULES), spark.createDataFrame([("kept", "7"), ("asia", "old")], "key string, value string"))
    found = rules.imported(documents, 0, empty)
    blank, nought = F.lit("").alias("status"), F.lit(0).cast("long")
    own = found.words.select(F.col("word").alias("original"), F.lit("").alias("replacement"), blank, "created_at", nought.alias("updated_at"), F.lit("personal_dictionary").alias("part"))
    settings = found.settings.select(F.col("key").alias("original"), F.col("value").alias("replacement"), blank, nought.alias("created_at"), nought.alias("updated_at"), F.lit("settings").alias("part"))
    return found.rules.withColumn("part", F.lit("correction_rules")).unionByName(own).unionByName(settings)


@query(f"WITH {SQL_MEMORY} SELECT original, replacement, status, status || ':' || url_encode(original) || ':' || url_encode(replacement) AS key FROM memory")
def rule_keys(spark, sf_dir):
    """The key each rule is stored under."""
    _, log = nation_memory(spark, sf_dir)
    return log.select("original", "replacement", "status", rule_key(F.col("status"), F.col("original"), F.col("replacement")).alias("key"))


@query(f"""WITH {SQL_MEMORY} SELECT 'france' AS asked, original, replacement, status FROM memory WHERE original = 'france' UNION ALL SELECT 'india in asia', original, replacement, status FROM memory WHERE original = 'india' AND replacement = 'ASIA'
 UNION ALL SELECT 'left', original, replacement, status FROM memory WHERE original <> 'kenya' AND NOT (original = 'china' AND replacement = 'ASIA') AND NOT (original = 'canada' AND replacement = 'ASIA')""")
def rule_lookup(spark, sf_dir):
    """Rules that answer look-ups, and those that are left when some are cleared."""
    _, log = nation_memory(spark, sf_dir)
    cleared = spark.createDataFrame([("Kenya", None), ("CHINA", "ASIA"), ("CANADA", "ASIA")], "original string, replacement string")
    answers = {"france": rules.rule_for(log, " FRANCE"), "india in asia": rules.rule_for(log, "India", "ASIA"), "none": rules.rule_for(log, "India", "EUROPE"), "left": rules.without_rules(log, cleared)}
    out = None
    for name, found in answers.items():
        named = found.select(F.lit(name).alias("asked"), "original", "replacement", "status")
        out = named if out is None else out.union(named)
    return out


def turns(spark, sf_dir):
    """Turns of conversations as snapshots of a text whose caret stands at its end."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), "text", F.length("text").alias("caret"), (F.col("role") == "system").alias("is_composing"))


@query(r"""WITH t AS (SELECT conv_id AS session, turn AS "at", text, regexp_replace(regexp_replace(text, '\s+\z', ''), '[.,!?;:)\]}]+\z', '') AS before FROM conversations
 WHERE role IS NOT NULL AND role <> 'system' AND right(text, 1) IN (' ', chr(10), chr(9), '.', ',', '!', '?', ';', ':', ')', ']', '}'))
SELECT session, "at", token, length(before) - length(token) AS start, length(before) AS "end" FROM (SELECT *, regexp_extract(before, '[^\s,!?;()\[\]{}]*\z') AS token FROM t) WHERE token <> ''""")
def completed_keystrokes(spark, sf_dir):
    """Tokens that the last character of a turn completes."""
    return keystrokes.completed(turns(spark, sf_dir)).select("session", "at", "token", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(r"""WITH t AS (SELECT right(text, 1) AS c FROM conversations) SELECT CASE WHEN c = chr(10) THEN 'newline' WHEN c IN (' ', chr(9)) THEN 'space' ELSE 'punctuation' END AS trigger, count(*) AS n
 FROM t WHERE c IN (' ', chr(10), chr(9), '.', ',', '!', '?', ';', ':', ')', ']', '}') GROUP BY 1""")
def typed_triggers(spark, sf_dir):
    """What the delimiters that turns end in are reported as; found before the caret, as no input data says."""
    at_end = turns(spark, sf_dir).select(editor.typed_delimiter(F.lit(None).cast("string"), F.col("text"), F.col("caret")).alias("c")).where("c is not null")
    return at_end.groupBy(editor.trigger(F.col("c")).alias("trigger")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') AND user_id <> 3 AND floor(value) = floor(value + 0.5) GROUP BY 1")
def ready_events(spark, sf_dir):
    """Events at which a token may be decided, if an error is read-only, a sign-up composes, a user is disabled, and values give selections."""
    whole = lambda c: F.floor(c).cast("int")
    events = read(spark, sf_dir, "events").select("event_type", whole(F.col("value")).alias("start"), whole(F.col("value") + 0.5).alias("end"), (F.col("event_type") == "error").alias("read_only"), (F.col("user_id") == 3).alias("disabled"), (F.col("event_type") == "signup").alias("is_composing"))
    return editor.ready(events).groupBy("event_type").agg(F.count("*").alias("n"))


def gate_query(settings):
    def run(spark, sf_dir):
        found = tokens.final_tokens(read(spark, sf_dir, "documents")).groupBy("token").count()
        asked = tokens.unprotected(found, F.col("count") > 0).select("token").union(vocabulary.typos(spark).select("typo")).distinct()
        gated = editor.gated(decide.decisions(asked, rules=rules.latest_rules(talked_rules(spark, sf_dir))), settings)
        return gated.withColumn("shown_mark", F.coalesce("shown_mark", F.lit("none"))).groupBy("action", "effect", "shown_mark").agg(F.count("*").alias("n"), F.count_if(F.get("shown_suggestions", F.lit(0)) == F.col("replacement")).alias("suggest_replacement"))

    return run


SQL_GATE = ORACLES["never_rules"].split("SELECT CASE WHEN reason")[0] + ", d AS (SELECT *, CASE WHEN reason = 'UNKNOWN_NON_WORD' OR never THEN 'mark_unresolved' WHEN reason IN ('ALWAYS_CORRECT_RULE', 'COMMON_TYPO_MATCH') THEN 'auto_correct' ELSE 'do_nothing' END AS action FROM acts), e AS (SELECT action, CASE <effect> END AS effect FROM d)"
SQL_GATE += " SELECT action, effect, CASE WHEN effect = 'red_mark' THEN 'red_spelling_issue' WHEN effect = 'edit' AND <kept> THEN 'blue_applied_correction' ELSE 'none' END AS shown_mark, count(*) AS n, count(*) FILTER (effect = 'red_mark' AND action = 'auto_correct') AS suggest_replacement FROM e GROUP BY 1, 2, 3"
GATES = {
    "gate_open": (editor.Settings(), "WHEN action = 'auto_correct' THEN 'edit' WHEN action = 'mark_unresolved' THEN 'red_mark' ELSE 'none'", "true"),
    "gate_no_autocorrect": (editor.Settings(autocorrect=False), "WHEN action <> 'do_nothing' THEN 'red_mark' ELSE 'none'", "true"),
    "gate_no_spelling": (editor.Settings(spellcheck=False, keep_marks=False), "WHEN action = 'auto_correct' THEN 'edit' ELSE 'none'", "false"),
    "gate_trusted": (editor.Settings(applied_reasons=("COMMON_TYPO_MATCH",)), "WHEN action = 'auto_correct' AND reason = 'COMMON_TYPO_MATCH' THEN 'edit' WHEN action <> 'do_nothing' THEN 'red_mark' ELSE 'none'", "true"),
}
for _name, (_settings, _effect, _kept) in GATES.items():
    QUERIES[_name], ORACLES[_name] = gate_query(_settings), SQL_GATE.replace("<effect>", _effect).replace("<kept>", _kept)


SQL_ODD = "(length({0}) - length(replace({0}, '`', '')) - (length({0}) - length(replace({0}, chr(92) || '`', ''))) / 2) % 2 = 1"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents),
f AS (SELECT *, regexp_matches(line, '\A\s*(```|~~~)') AS fence, regexp_replace(line, '\A\s+', '') AS t FROM l),
o AS (SELECT *, fence OR coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced,
 t <> '' AND NOT starts_with(t, '#') AND (regexp_matches(t, '\A([$>]|PS\s+[^>]+>)\s+\S') OR (contains(t, ' ') AND lower(regexp_extract(t, '\A([A-Za-z][A-Za-z0-9_.-]*)(\s|\z)', 1)) IN ({", ".join(f"'{c}'" for c in protect.COMMANDS)}))) AS command FROM f),
r AS (SELECT doc_id, number, line, fenced, command, regexp_extract_all(line, '{RUN}|[ \n\t,!?;()\[\]{{}}]') AS runs FROM o),
p AS (SELECT *, unnest(runs) AS run, generate_subscripts(runs, 1) AS pos FROM r),
e AS (SELECT doc_id, line, fenced, command, run, regexp_replace(run, '[.:]+\z', '') AS token, lead(run) OVER w AS next, coalesce(sum(length(run)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p WINDOW w AS (PARTITION BY doc_id, number ORDER BY pos)),
k AS (SELECT *, substr(line, 1, start) AS a, substr(line, start + length(token) + 1) AS z FROM e WHERE token <> '' AND regexp_matches(run, '\A{RUN}\z') AND (token <> run OR next IN (' ', chr(10), chr(9), '.', ',', '!', '?', ';', ':', ')', ']', '}}'))),
g AS (SELECT doc_id, fenced, command, {SQL_ODD.format("a")} AND {SQL_ODD.format("z")} AS code, regexp_matches(a, '\]\([^)]*\z') AS link, lower(token) IN ('http', 'https', 'ftp') AND starts_with(z, ':') AS scheme FROM k)
SELECT doc_id, count(*) AS tokens, count(*) FILTER (code) AS in_code, count(*) FILTER (link) AS in_links, count(*) FILTER (scheme) AS schemes, count(*) FILTER (fenced OR command OR code OR link OR scheme) AS guarded FROM g GROUP BY 1""")
def guarded_tokens(spark, sf_dir):
    """Tokens of each document's lines by the guard that protects their place."""
    lines = protect.lines(read(spark, sf_dir, "documents"), "doc_id")
    counts = ("tokens", "in_code", "in_links", "schemes", "guarded")
    found = lines.select("doc_id", protect.guarded_counts(F.col("line"), F.col("fenced")).alias("n"))
    return found.groupBy("doc_id").agg(*(F.sum(f"n.{c}").alias(c) for c in counts)).where("tokens > 0")


SQL_TRANSACTIONS = CORRECTION_ORACLES["correction_transactions"].split("t AS (")[1].split(") SELECT doc_id, id, start::INT")[0]


@query(rf"""WITH {SQL_PLACED}, t AS ({SQL_TRANSACTIONS}), m AS (SELECT doc_id, new_start AS mark_start, CASE WHEN original = 'ou' THEN NULL ELSE id END AS event_id, original FROM t)
SELECT doc_id, m.mark_start::INT AS mark_start, t.id IS NOT NULL AS known, coalesce(t.replacement, m.original) AS replacement FROM m LEFT JOIN t USING (doc_id) WHERE t.id = m.event_id OR (m.event_id IS NULL AND t.new_start = m.mark_start)""".replace("t.id IS NOT NULL AS known, coalesce(t.replacement, m.original) AS replacement", "m.event_id IS NOT NULL AS known, CASE WHEN m.event_id IS NULL THEN m.original ELSE t.replacement END AS replacement"))
def mark_transactions(spark, sf_dir):
    """Marks of corrections with their transactions; those of one word have lost theirs."""
    done = marks.transactions(user_edits(spark, sf_dir))
    lost = done.select("doc_id", F.col("new_start").alias("mark_start"), F.col("new_end").alias("mark_end"), "original", F.when(F.col("original") != "ou", F.col("id")).alias("event_id"))
    return marks.with_transactions(lost, done).select("doc_id", "mark_start", "known", "replacement")


@query("""WITH f AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS inserted, length(text) // 2 AS "at" FROM conversations),
g AS (SELECT *, left(text, "at") || CASE WHEN turn % 3 = 0 AND inserted <> '' THEN replace(inserted, 'e', '3') || '#' ELSE coalesce(inserted, '') END || substr(text, "at" + 1) AS now FROM f),
h AS (SELECT *, CASE WHEN inserted IS NULL THEN 'missing_transaction' WHEN substr(now, "at" + 1, length(inserted)) = inserted THEN 'reverted' ELSE 'stale_range' END AS result FROM g)
SELECT conv_id, turn, result, CASE WHEN result = 'reverted' THEN left(now, "at") || substr(now, "at" + 1 + length(inserted)) ELSE now END AS text FROM h""")
def completion_reverts(spark, sf_dir):
    """The next turn inserted in the middle of each, changed in every third, and then reverted."""
    half = F.floor(F.length("text") / 2).cast("int")
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("inserted"), half.alias("at"))
    changed = F.when((F.col("turn") % 3 == 0) & (F.col("inserted") != ""), F.concat(F.replace("inserted", F.lit("e"), F.lit("3")), F.lit("#"))).otherwise(F.coalesce("inserted", F.lit("")))
    texts = found.select(F.struct("conv_id", "turn").alias("place"), spans.replaced(F.col("text"), F.col("at"), F.col("at"), changed).alias("text"))
    accepted = found.where("inserted is not null").select(F.struct("conv_id", "turn").alias("place"), "at", "inserted")
    return marks.completion_reverted(texts, accepted, "place").select("place.conv_id", "place.turn", "result", "text")


@query("SELECT event_type, count(value) FILTER (value >= 1e9) AS count, max(value) FILTER (value >= 1e9) IS NULL AS no_max, quantile_disc(value, 0.95) FILTER (value >= 1e9) IS NULL AS no_p95 FROM events GROUP BY 1")
def latency_empty(spark, sf_dir):
    """A summary of latencies that none of the events reaches: null, not nought."""
    events = read(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") >= 1e9, F.col("value")))
    return metrics.latency_summary(events, "value", "event_type", empty=None).select("event_type", "count", F.col("max").isNull().alias("no_max"), F.col("p95").isNull().alias("no_p95"))


@query(rf"""WITH {SQL_TOKENS}, {SQL_KNOWN}, {SQL_TYPO}, typed AS (SELECT lang, token, token AS t FROM tok), d AS (SELECT lang, token, {SQL_TYPE} <> 'word' AS protected FROM typed)
SELECT lang, count(*) FILTER (NOT protected AND token NOT IN (SELECT word FROM known) AND token IN (SELECT token FROM typo)) AS corrections,
 count(*) FILTER (NOT protected AND token NOT IN (SELECT word FROM known) AND token NOT IN (SELECT token FROM typo) AND regexp_matches(token, '\A[a-z]+\z')) AS unresolved, count(*) FILTER (protected) AS protected_skips, 0::BIGINT AS reverts FROM d GROUP BY 1""")
def session_counts(spark, sf_dir):
    """Corrections, unknown words and skipped tokens of the documents of each language."""
    found = tokens.classified(tokens.final_tokens(read(spark, sf_dir, "documents"), "lang").groupBy("lang", "token").count())
    decided = decide.decisions(found.where("not protected")).select("token", "action")
    rows = found.join(decided, "token", "left").withColumn("action", F.coalesce("action", F.lit("do_nothing")))
    return editor.session_counts(rows, "lang", weight="count")


@query("""WITH c AS (SELECT conv_id, turn, text, length(text) // 2 AS mid, length(text) // 4 AS low FROM conversations)
SELECT conv_id, turn, left(text, low) || '<' || substr(text, mid + 1) AS text, low + 1 AS caret_inside, length(text) + 1 - (mid - low) AS caret_at_end FROM c""")
def spliced_turns(spark, sf_dir):
    """The second quarter of each turn replaced by one character, and where selections go."""
    low, mid, size = F.floor(F.length("text") / 4).cast("int"), F.floor(F.length("text") / 2).cast("int"), F.length("text")
    low, mid = spans.clamp(low, size), spans.clamp(mid, size)
    inside = spans.moved(mid, low, mid, F.lit(1)).cast("long")
    at_end = spans.moved(size, low, mid, F.lit(1)).cast("long")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", spans.replaced(F.col("text"), low, mid, F.lit("<")).alias("text"), inside.alias("caret_inside"), at_end.alias("caret_at_end"))


@query("""WITH c AS (SELECT conv_id, turn, text, length(text) // 2 AS mid FROM conversations) SELECT conv_id, turn, replace(right(left(text, mid), 2000), 'e', '*') AS context_before, replace(substr(substr(text, mid + 1), 1, 300), 'e', '*') AS context_after FROM c""")
def redacted_context(spark, sf_dir):
    """The context in the middle of each turn, with a letter blotted out."""
    blot = lambda t: F.replace(t, F.lit("e"), F.lit("*"))
    found = completion.context(F.col("text"), F.floor(F.length("text") / 2).cast("int"), redact=lambda a, b: (blot(a), blot(b)))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("c")).select("conv_id", "turn", "c.context_before", "c.context_after")


@query("""WITH c AS (SELECT conv_id, turn, right(left(text, length(text) // 2), 2000) AS a, substr(substr(text, length(text) // 2 + 1), 1, 300) AS z, role FROM conversations)
SELECT conv_id, turn, 'completion-' || turn AS id, 'inline' AS mode, md5(a) AS before, md5(z) AS after, regexp_extract(a, '[^\\n\\r]*\\z') AS line, length(a) AS cursor, 220 AS most, '. |' || chr(10) AS stops, 'continue/same_voice/continuation_only/10' AS instruction, role FROM c""")
def request_bodies(spark, sf_dir):
    """The JSON that a provider gets for a completion in the middle of each turn, read back field by field."""
    c = completion.context(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    asked = read(spark, sf_dir, "conversations").withColumn("c", c)
    body = completion.request(
        F.concat(F.lit("completion-"), F.col("turn").cast("string")), F.lit("inline"), F.col("c"), stops=F.array(F.lit(". "), F.lit("\n")), extras=("Keep to the subject.",), metadata=F.struct("role"),
    )
    back = F.from_json(body, completion.REQUEST + ", metadata struct<role:string>").alias("r")
    i = F.col("r.instruction")
    told = F.concat_ws("/", i["task"], i["style"], i["output"], F.size(i["constraints"]))
    return asked.select("conv_id", "turn", back).select(
        "conv_id", "turn", "r.id", "r.mode", F.md5(F.col("r.contextBefore").cast("binary")).alias("before"), F.md5(F.col("r.contextAfter").cast("binary")).alias("after"), F.col("r.currentLine").alias("line"),
        F.col("r.cursorOffset").cast("long").alias("cursor"), F.col("r.maxCompletionChars").alias("most"), F.array_join("r.stopSequences", "|").alias("stops"), told.alias("instruction"), "r.metadata.role",
    )


@query("SELECT event_type, lower(trim(event_type)) AS surface, count(*) AS n FROM events GROUP BY 1")
def surfaces(spark, sf_dir):
    """Event types as names of surfaces: trimmed and in lower case."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("surface", metrics.surface(F.concat(F.lit(" "), F.upper("event_type"), F.lit("\t"))))


@query("SELECT reason, CASE WHEN reason IN ('typing', 'escape', 'selection_change', 'blur', 'composition') THEN 'ghost_dismissed_by_' || reason ELSE 'none' END AS type FROM (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'typing' WHEN 'view' THEN 'blur' ELSE event_type END AS reason FROM events)")
def dismissal_types(spark, sf_dir):
    """Metric types of dismissals for reasons."""
    reason = F.when(F.col("event_type") == "click", "typing").when(F.col("event_type") == "view", "blur").otherwise(F.col("event_type"))
    return metric_events(spark, sf_dir).select(reason.alias("reason")).distinct().withColumn("type", F.coalesce(metrics.dismissal_type(F.col("reason")), F.lit("none")))


LIFE = {"click": "schedule", "view": "response", "purchase": "accept", "error": "cancel", "signup": "dismiss"}
SQL_LIFE = "e AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LIFE.items()) + " END AS type FROM events)"


@query(f"""WITH {SQL_LIFE}, p AS (SELECT *, at_ms::HUGEINT * 10000000 + seq AS place, type = 'schedule' AND seq % 40 >= {requests.LEAST_CONTEXT} AS asks FROM e),
n AS (SELECT *, sum(asks::INT) OVER (PARTITION BY session ORDER BY place) AS n FROM p),
s AS (SELECT session, n, min(place) FILTER (asks) AS begun, min(place) FILTER (type = 'cancel') AS canceled, min(place) FILTER (type = 'schedule' AND NOT asks) AS short, min(place) FILTER (type = 'dismiss') AS dm FROM n WHERE n > 0 GROUP BY 1, 2),
d AS (SELECT *, least(short, lead(begun) OVER (PARTITION BY session ORDER BY n)) AS typed FROM s), d1 AS (SELECT *, least(canceled, typed) AS stop1, begun // 10000000 + 60000 AS due FROM d),
a AS (SELECT session, n - seq % 2 AS n, min(place) AS reply FROM n WHERE type = 'response' GROUP BY 1, 2),
j AS (SELECT d1.*, reply, reply // 10000000 AS received FROM d1 LEFT JOIN a USING (session, n)),
k AS (SELECT *, CASE WHEN (stop1 IS NULL OR stop1 // 10000000 >= due) AND received >= due AND (stop1 IS NULL OR received < stop1 // 10000000) AND received <= due + 3600000 THEN reply END AS ghost1 FROM j),
u AS (SELECT *, dm IS NOT NULL AND (stop1 IS NULL OR dm < stop1) AND (ghost1 IS NULL OR dm < ghost1) AS early FROM k), v AS (SELECT *, CASE WHEN early THEN dm ELSE stop1 END AS stop FROM u),
w AS (SELECT *, CASE WHEN stop IS NULL OR stop // 10000000 >= due THEN due END AS sent, stop // 10000000 AS ended FROM v),
x AS (SELECT *, CASE WHEN received >= sent AND (ended IS NULL OR received < ended) AND received <= sent + 3600000 THEN reply END AS ghost FROM w),
l AS (SELECT x.session, x.n, arg_min(n.type, n.place) AS act FROM x JOIN n ON x.session = n.session AND x.n = n.n AND n.type IN ('accept', 'dismiss') AND n.place >= ghost AND (stop IS NULL OR n.place < stop) GROUP BY 1, 2),
m AS (SELECT unnest(['request_scheduled', CASE WHEN sent IS NULL THEN 'request_canceled_before_send' END, CASE WHEN ghost IS NULL AND ended <= sent + 3600000 THEN 'request_aborted_in_flight' END,
 CASE WHEN ghost IS NULL AND sent IS NOT NULL AND (ended IS NULL OR ended > sent + 3600000) THEN 'provider_error' END, CASE WHEN ghost IS NOT NULL THEN 'provider_latency' END, CASE WHEN ghost IS NOT NULL THEN 'ghost_shown' END,
 CASE WHEN ghost IS NULL AND received IS NOT NULL THEN 'stale_response_dropped' END, CASE act WHEN 'accept' THEN 'ghost_accepted' WHEN 'dismiss' THEN 'ghost_dismissed_by_escape' ELSE CASE WHEN ghost IS NOT NULL AND NOT early AND stop = typed THEN 'ghost_dismissed_by_typing' END END]) AS type, begun % 10000000 % 40 AS context, CASE WHEN ghost IS NOT NULL THEN 8 END AS shown FROM x LEFT JOIN l USING (session, n))
SELECT type, count(*) AS n, sum(context)::BIGINT AS context, coalesce(sum(CASE WHEN type IN ('provider_latency', 'ghost_shown', 'ghost_accepted') OR starts_with(type, 'ghost_dismissed') THEN shown END), 0)::BIGINT AS shown FROM m WHERE type IS NOT NULL GROUP BY 1""")
def request_lives(spark, sf_dir):
    """The event table read as completion requests of each user, some with too short a context, with a wait of a minute and a limit of an hour: metric events by type."""
    kinds = F.create_map(*[F.lit(x) for kv in LIFE.items() for x in kv])
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("type"))
    events = events.withColumn("context_length", (F.col("seq") % 40).cast("int"))
    order = Window.partitionBy("session").orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    asks = (F.col("type") == "schedule") & (F.col("context_length") >= requests.LEAST_CONTEXT)
    events = events.select("*", (F.sum(asks.cast("int")).over(order) - F.col("seq") % 2).alias("request"), F.col("type").alias("text"), F.lit("escape").alias("reason"))
    return requests.metric_rows(requests.lives(events, 60_000, 3_600_000), 3_600_000).groupBy("type").agg(F.count("*").alias("n"), F.sum("context_length").alias("context"), F.coalesce(F.sum("completion_length"), F.lit(0)).alias("shown"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, length(v) AS n, md5(v) AS text_md5 FROM (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS v FROM a)""")
def page_texts(spark, sf_dir):
    """The text of each page: its length and digest."""
    text = visible(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


@query("""WITH f AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(before) AS ghosts, count(*) FILTER (before = text AND turn % 2 = 0) AS kept FROM f GROUP BY 1""")
def ghosts_kept(spark, sf_dir):
    """Completions shown at one turn that may stay at the next: where the text is the same and has focus."""
    state = lambda text: F.struct(F.lit(1).alias("version"), text.alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end"), (F.col("turn") % 2 == 0).alias("focused"))
    found = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    kept = F.col("before").isNotNull() & editor.still_shown(state(F.col("before")), state(F.col("text")))
    return found.groupBy("conv_id").agg(F.count("before").alias("ghosts"), F.count_if(kept).alias("kept"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, length(regexp_extract(text, '\A[^ ]*')) AS n FROM conversations)
SELECT conv_id, turn, n::BIGINT AS "end", NOT regexp_matches(substr(text, n + 1, 1), '[A-Za-z'']') AS word, true AS held, n < 2 OR NOT regexp_matches(substr(text, n, 1), '[A-Za-z'']') AS cut_short FROM c""")
def range_checks(spark, sf_dir):
    """Whether each turn's first word is still found at its place, as a word or as it stands, and without its last letter."""
    first = F.regexp_extract("text", r"\A[^ ]*", 0)
    nought, n = F.lit(0), F.length(first)
    less = F.greatest(n - 1, nought)
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", n.cast("long").alias("end"), spans.still_matches(F.col("text"), nought, n, first).alias("word"), spans.holds(F.col("text"), nought, n, first).alias("held"),
        F.when(n < 2, True).otherwise(spans.still_matches(F.col("text"), nought, less, F.substring(first, F.lit(1), less))).alias("cut_short"),
    )
