"""Queries over the corpus tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import completion, spans
from ..operators import decide, marks, metrics, protect, rules, tokens
from ..sources import blob, vocabulary

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The user's memory in the queries that need one: own words, and rules over words of the corpus.
OWN_WORDS = (("thon", 1), ("Onth ", 2), ("reea", 3))
RULES = (
    ("ou", "you", "always", 1, 1), ("HA", "had", "always", 2, 2), ("ha", "has", "always", 3, 3), ("onth", "month", "always", 4, 4),
    ("teh", "the", "never", 5, 5), ("zu", "to", "always", 6, 6), ("an", "a", "always", 7, 7),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# SQL building blocks.  \z and classes without look-around mean the same in both regex dialects.
RUN = r"[^ \n\t,!?;()\[\]{}]+"
SQL_TOKENS = rf"""
pieces AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{RUN}[ \n\t,!?;)\]}}]?')) AS piece FROM documents),
runs AS (SELECT doc_id, lang, piece, regexp_replace(piece, '[ \n\t,!?;)\]}}]\z', '') AS run FROM pieces),
cut AS (SELECT doc_id, lang, piece, run, regexp_replace(run, '[.:]+\z', '') AS token FROM runs),
tok AS (SELECT doc_id, lang, token FROM cut WHERE token <> '' AND (piece <> run OR token <> run))"""
SQL_TYPE = r"""
CASE WHEN t = '' THEN 'mixed'
 WHEN starts_with(t, '```') OR ends_with(t, '```') OR (length(t) >= 2 AND starts_with(t, '`') AND ends_with(t, '`')) OR t IN ('nmap', 'sqlmap')
  OR regexp_matches(t, '\b(const|let|var|function|return|class|import|export)\b') OR regexp_matches(t, '[=;{}]') THEN 'code'
 WHEN regexp_matches(t, '(?i)\Ahttps?://\S+\z') THEN 'url'
 WHEN regexp_matches(t, '\A[^\s@]+@[^\s@]+\.[^\s@]+\z') THEN 'email'
 WHEN regexp_matches(t, '\A(/|~/|\.{1,2}/|[A-Za-z]:[\\/])') OR contains(t, '\') THEN 'path'
 WHEN regexp_matches(t, '\A[0-9]+(\.[0-9]+)?\z') THEN 'number'
 WHEN regexp_matches(t, '\A([A-Z]{2,}|[a-z]+([A-Z][A-Za-z0-9]*)+|[A-Z][a-z0-9]+([A-Z][A-Za-z0-9]*)+|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)\z') THEN 'identifier'
 WHEN regexp_matches(t, '[^\x00-\x7F]') OR (regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9\-_.:@/\\A-Z]')) THEN 'mixed'
 WHEN regexp_matches(t, '\A[a-z]+(''[a-z]+)?\z') THEN 'word' ELSE 'mixed' END"""
SQL_KNOWN = "known AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '" + w.replace("'", "''") + "')" for k, w in enumerate(vocabulary.KNOWN_WORDS)) + ") v(load_order, word))"
SQL_TYPO = "typo AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in vocabulary.TYPOS) + ") v(token, replacement))"
SQL_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{o}', '{r}', '{s}', {c}, {u})" for o, r, s, c, u in RULES) + ") v(original, replacement, status, created_at, updated_at))"
SQL_OWN = "own AS (SELECT DISTINCT lower(trim(word)) AS token FROM (VALUES " + ", ".join(f"('{w}')" for w, _ in OWN_WORDS) + ") v(word))"
SQL_FUZZY = "pairs AS (SELECT token, source, load_order, word, frequency, levenshtein(token, word) AS distance FROM asked JOIN words ON token <> word AND abs(length(token) - length(word)) <= 2 AND length(token) <= 64 AND levenshtein(token, word) <= 2)"
SQL_DICTIONARY = rf"""
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counted AS (SELECT token AS word, count(*) AS frequency FROM tok JOIN good USING (doc_id) WHERE regexp_matches(token, '\A[a-z]{{2,}}\z') GROUP BY 1),
top AS (SELECT * FROM counted ORDER BY frequency DESC, word LIMIT {vocabulary.WORDS}),
dictionary AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS load_order, word, frequency, CAST(0 AS BIGINT) AS flags FROM top)"""
SQL_WORDS = "words AS (SELECT 0 AS source, load_order, word, frequency FROM dictionary UNION ALL SELECT 1, load_order, word, 0 FROM known WHERE word NOT IN (SELECT word FROM dictionary))"
SQL_RANKED = """
capped AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY source, load_order, word) AS place FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, word) AS rank FROM capped WHERE place <= 256)"""


@query(rf"WITH {SQL_TOKENS}, typed AS (SELECT token AS t FROM tok) SELECT {SQL_TYPE} AS token_type, count(*) AS n FROM typed GROUP BY 1")
def token_classes(spark, sf_dir):
    """Completed tokens of the corpus by class."""
    found = tokens.final_tokens(read(spark, sf_dir, "documents"))
    return tokens.classified(found.groupBy("token").count()).groupBy("token_type").agg(F.sum("count").alias("n"))


@query(rf"""WITH {SQL_TOKENS}, {SQL_KNOWN}, {SQL_TYPO}, typed AS (SELECT lang, token, token AS t FROM tok), kept AS (SELECT lang, token FROM typed WHERE {SQL_TYPE} = 'word'),
asked AS (SELECT DISTINCT token FROM kept WHERE regexp_matches(token, '\A[a-z]+\z')), words AS (SELECT 1 AS source, load_order, word, 0 AS frequency FROM known), {SQL_FUZZY}, near AS (SELECT DISTINCT token FROM pairs),
decided AS (SELECT lang, CASE WHEN token IN (SELECT word FROM known) THEN 'do_nothing' WHEN NOT regexp_matches(token, '\A[a-z]+\z') THEN 'do_nothing' WHEN token IN (SELECT token FROM typo) THEN 'auto_correct' ELSE 'mark_unresolved' END AS action,
 CASE WHEN token IN (SELECT word FROM known) THEN 'KNOWN_VALID_WORD' WHEN NOT regexp_matches(token, '\A[a-z]+\z') THEN 'PROTECTED_LOOKING_TOKEN' WHEN token IN (SELECT token FROM typo) THEN 'COMMON_TYPO_MATCH'
 WHEN token IN (SELECT token FROM near) THEN 'UNKNOWN_NON_WORD,EDIT_DISTANCE_SUGGESTIONS' ELSE 'UNKNOWN_NON_WORD,NO_SUGGESTIONS' END AS reasons FROM kept)
SELECT lang, action, reasons, count(*) AS n FROM decided GROUP BY ALL""")
def token_decisions(spark, sf_dir):
    """What the engine decides about the corpus's unprotected tokens, by language, action and reason."""
    found = tokens.final_tokens(read(spark, sf_dir, "documents"), "lang").groupBy("lang", "token").count()
    found = tokens.unprotected(found, F.col("count") > 0)
    decided = decide.decisions(found).select("token", "action", F.array_join("reason_codes", ",").alias("reasons"))
    return found.join(decided, "token").groupBy("lang", "action", "reasons").agg(F.sum("count").alias("n"))


@query(rf"WITH {SQL_TOKENS}, {SQL_KNOWN} SELECT word, count(token) AS n FROM known LEFT JOIN tok ON token = word GROUP BY 1")
def known_words(spark, sf_dir):
    """Occurrences of each built-in word."""
    found = tokens.final_tokens(read(spark, sf_dir, "documents")).join(F.broadcast(vocabulary.known_words(spark).select(F.col("word").alias("token"))), "token").groupBy("token").agg(F.count("*").alias("n"))
    return vocabulary.known_words(spark).select("word").join(found, F.col("word") == F.col("token"), "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


@query(rf"WITH {SQL_TOKENS}, {SQL_KNOWN}, asked AS (SELECT DISTINCT token FROM tok WHERE regexp_matches(token, '\A[a-z]+\z')), words AS (SELECT 1 AS source, load_order, word, 0 AS frequency FROM known), {SQL_FUZZY} SELECT token, word, distance FROM pairs")
def fuzzy_candidates(spark, sf_dir):
    """Distinct corpus words within edit distance two of a built-in word."""
    found = tokens.final_tokens(read(spark, sf_dir, "documents")).where(F.col("token").rlike(r"\A[a-z]+\z")).select("token").distinct()
    return decide.fuzzy_pairs(found, decide.vocabulary(spark), decide.SCANNED).select("token", "word", F.col("distance").cast("long").alias("distance"))


@query(rf"WITH {SQL_TOKENS}, {SQL_DICTIONARY} SELECT * FROM dictionary")
def corpus_dictionary(spark, sf_dir):
    """A loadable dictionary from the commonest words of good documents."""
    return vocabulary.corpus_dictionary(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def unknown_tokens(spark, sf_dir, dictionary):
    found = tokens.final_tokens(read(spark, sf_dir, "conversations")).where(F.col("token").rlike(r"\A[a-z]+\z")).select("token").distinct()
    known = dictionary.select(F.col("word").alias("token")).union(vocabulary.known_words(spark).select("word"))
    return found.join(F.broadcast(known), "token", "left_anti")


SQL_UNKNOWN = rf"""{SQL_TOKENS}, {SQL_KNOWN}, {SQL_DICTIONARY}, {SQL_WORDS},
talk AS (SELECT unnest(regexp_extract_all(text, '{RUN}[ \n\t,!?;)\]}}]?')) AS piece FROM conversations),
talk2 AS (SELECT piece, regexp_replace(piece, '[ \n\t,!?;)\]}}]\z', '') AS run FROM talk),
talk3 AS (SELECT piece, run, regexp_replace(run, '[.:]+\z', '') AS token FROM talk2),
asked AS (SELECT DISTINCT token FROM talk3 WHERE (piece <> run OR token <> run) AND regexp_matches(token, '\A[a-z]+\z') AND token NOT IN (SELECT word FROM words)), {SQL_FUZZY}"""


@query(rf"WITH {SQL_UNKNOWN}, {SQL_RANKED} SELECT token, rank, word[1:31] AS word, distance, (3 - distance) * 2.0::DOUBLE + least(frequency, 1000000) / 1000000::DOUBLE AS score FROM ranked WHERE rank <= 4")
def topk_suggestions(spark, sf_dir):
    """Four best suggestions for the unknown words of conversations, from the corpus dictionary."""
    dictionary = corpus_dictionary(spark, sf_dir)
    found = decide.suggestions(unknown_tokens(spark, sf_dir, dictionary), decide.vocabulary(spark, dictionary), vocabulary.WORDS + decide.SCANNED)
    return found.select("token", "rank", "word", F.col("distance").cast("long").alias("distance"), "score")


@query(rf"WITH {SQL_UNKNOWN}, n AS (SELECT token, count(*) AS candidates FROM pairs GROUP BY 1) SELECT token, candidates, least(candidates, 256) AS kept FROM n")
def candidate_cap(spark, sf_dir):
    """Candidates of each unknown word, and how many the engine's buffer keeps."""
    dictionary = corpus_dictionary(spark, sf_dir)
    pairs = decide.fuzzy_pairs(unknown_tokens(spark, sf_dir, dictionary), decide.vocabulary(spark, dictionary), vocabulary.WORDS + decide.SCANNED)
    return pairs.groupBy("token").agg(F.count("*").alias("candidates")).withColumn("kept", F.least("candidates", F.lit(decide.CANDIDATES)))


@query(rf"""WITH {SQL_TOKENS}, {SQL_KNOWN}, {SQL_DICTIONARY}, {SQL_TYPO}, {SQL_RULES}, {SQL_OWN}, always AS (SELECT lower(original) AS token, arg_max(replacement, updated_at) AS replacement FROM rules WHERE status = 'always' GROUP BY 1),
typed AS (SELECT token, token AS t FROM tok), kept AS (SELECT token FROM typed WHERE {SQL_TYPE} = 'word'),
decided AS (SELECT CASE WHEN token IN (SELECT token FROM own) THEN 'PERSONAL_DICTIONARY_MATCH' WHEN token IN (SELECT token FROM always) THEN 'ALWAYS_CORRECT_RULE' WHEN token IN (SELECT word FROM dictionary) THEN 'DYNAMIC_DICTIONARY_MATCH'
 WHEN token IN (SELECT word FROM known) THEN 'KNOWN_VALID_WORD' WHEN NOT regexp_matches(token, '\A[a-z]+\z') THEN 'PROTECTED_LOOKING_TOKEN' WHEN token IN (SELECT token FROM typo) THEN 'COMMON_TYPO_MATCH' ELSE 'UNKNOWN_NON_WORD' END AS reason FROM kept)
SELECT reason, count(*) AS n FROM decided GROUP BY 1""")
def personal_rules(spark, sf_dir):
    """Decisions with the user's words and rules and the corpus dictionary, by first reason."""
    found = tokens.final_tokens(read(spark, sf_dir, "documents")).groupBy("token").count()
    found = tokens.unprotected(found, F.col("count") > 0)
    own = spark.createDataFrame(list(OWN_WORDS), rules.WORDS)
    decided = decide.decisions(found, corpus_dictionary(spark, sf_dir), own, rules.latest_rules(spark.createDataFrame(list(RULES), rules.RULES)), size=vocabulary.WORDS)
    return found.join(decided.select("token", F.col("reason_codes")[0].alias("reason")), "token").groupBy("reason").agg(F.sum("count").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents),
f AS (SELECT *, regexp_matches(line, '\A\s*(```|~~~)') AS fence FROM l), o AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS opened FROM f)
SELECT doc_id, count(*) AS lines, count(*) FILTER (fence OR opened) AS fenced FROM o GROUP BY 1""")
def fence_lines(spark, sf_dir):
    """Lines and fenced lines of each document."""
    return protect.lines(read(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("fenced").alias("fenced"))


def user_decisions(spark):
    """Decisions that the rules alone cause, over their words."""
    log = rules.latest_rules(spark.createDataFrame(list(RULES), rules.RULES))
    return decide.decisions(log.select(F.col("original").alias("token")), rules=log).where("action = 'auto_correct'")


SQL_PLACED = rf"""{SQL_RULES}, always AS (SELECT lower(original) AS token, arg_max(replacement, updated_at) AS replacement FROM rules WHERE status = 'always' GROUP BY 1),
lists AS (SELECT doc_id, text, regexp_extract_all(text, '{RUN}|[ \n\t,!?;()\[\]{{}}]') AS runs FROM documents),
placed AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS pos FROM lists),
ends AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lead(run) OVER (PARTITION BY doc_id ORDER BY pos) AS next, regexp_replace(run, '[.:]+\z', '') AS token FROM placed),
edits AS (SELECT doc_id, pos, start, start + length(token) AS end_, token AS original, replacement, run FROM ends JOIN always USING (token) WHERE token <> run OR next IN (' ', chr(10), chr(9), '.', ',', '!', '?', ';', ':', ')', ']', '}}'))"""


def user_edits(spark, sf_dir):
    return marks.edits(read(spark, sf_dir, "documents"), user_decisions(spark))


@query(rf"""WITH {SQL_PLACED}, swapped AS (SELECT e.doc_id, e.pos, CASE WHEN d.original IS NULL THEN e.run ELSE d.replacement || substr(e.run, length(d.original) + 1) END AS piece, d.original IS NOT NULL AS hit FROM ends e LEFT JOIN edits d USING (doc_id, pos))
SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS text, count(*) FILTER (hit) AS n_edits FROM swapped GROUP BY 1 HAVING count(*) FILTER (hit) > 0""")
def corrected_docs(spark, sf_dir):
    """Documents with the user's corrections applied."""
    docs = read(spark, sf_dir, "documents")
    return marks.corrected(docs, marks.edit_lists(docs, user_decisions(spark))).select("doc_id", "text", "n_edits")


SQL_TRANSACTIONS = """SELECT doc_id, 'correction-' || (2 * row_number() OVER w - 1) AS id, start, end_ AS "end", original, replacement,
 start + coalesce(sum(length(replacement) - length(original)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start FROM edits WINDOW w AS (PARTITION BY doc_id ORDER BY start)"""


@query(rf"""WITH {SQL_PLACED}, t AS ({SQL_TRANSACTIONS}) SELECT doc_id, id, start::INT AS start, "end"::INT AS "end", original, replacement, new_start::INT AS new_start, (new_start + length(replacement))::INT AS new_end FROM t""")
def correction_transactions(spark, sf_dir):
    """Each correction with its range before and after all corrections of the document."""
    return marks.transactions(user_edits(spark, sf_dir)).select("doc_id", "id", "start", "end", "original", "replacement", "new_start", "new_end")


@query(rf"WITH {SQL_PLACED}, t AS ({SQL_TRANSACTIONS}) SELECT 'reverted' AS result, count(*) AS n FROM t")
def reverts(spark, sf_dir):
    """Each correction reverted alone in the corrected text: all ranges still hold."""
    edited = user_edits(spark, sf_dir)
    done = marks.transactions(edited)
    return marks.reverted(marks.corrected(read(spark, sf_dir, "documents"), edited), done).groupBy("result").agg(F.count("*").alias("n"))


@query(rf"""WITH {SQL_PLACED}, m AS (SELECT doc_id, min(start) AS mark_start, min(start) + 1 AS mark_end, 'q' AS kind FROM ends WHERE starts_with(run, 'T') GROUP BY 1),
j AS (SELECT m.doc_id, mark_start, mark_end, coalesce(sum(length(replacement) - length(original)) FILTER (end_ <= mark_start), 0) AS move, count(*) FILTER (start < mark_end AND mark_start < end_) AS hit FROM m LEFT JOIN edits e USING (doc_id) GROUP BY ALL)
SELECT doc_id, (mark_start + move)::INT AS mark_start, (mark_end + move)::INT AS mark_end FROM j WHERE hit = 0""")
def marks_shift(spark, sf_dir):
    """A mark on each document's first word with a capital T, after the corrections before it."""
    at = F.regexp_instr("text", F.lit(r"(?<![^ \n\t,!?;()\[\]{}])T"))
    first = read(spark, sf_dir, "documents").select("doc_id", (at - 1).alias("mark_start"), at.alias("mark_end")).where("mark_start >= 0")
    return marks.shifted(first, user_edits(spark, sf_dir)).select("doc_id", "mark_start", "mark_end")


EVENT_TYPES = {"click": "request_scheduled", "view": "ghost_shown", "purchase": "ghost_accepted", "error": "provider_error", "signup": "ghost_dismissed_by_typing"}


def metric_events(spark, sf_dir):
    """The event table read as metric events."""
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return read(spark, sf_dir, "events").withColumn("type", kinds[F.col("event_type")])


SQL_EVENTS = "e AS (SELECT *, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_TYPES.items()) + " END AS type FROM events)"
SQL_TYPES = "types AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in metrics.TYPES) + ") v(type))"


@query(f"WITH {SQL_EVENTS}, {SQL_TYPES} SELECT t.type, count(e.type) AS n FROM types t LEFT JOIN e ON e.type = t.type GROUP BY 1")
def metric_counts_zero_filled(spark, sf_dir):
    return metrics.counts_by_type(metric_events(spark, sf_dir), metrics.TYPES)


@query("SELECT event_type, count(value) FILTER (value >= 0) AS count, round(coalesce(avg(value) FILTER (value >= 0), 0), 6) AS mean, " + ", ".join(f"coalesce(quantile_disc(value, {p}) FILTER (value >= 0), 0) AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + ", coalesce(max(value) FILTER (value >= 0), 0) AS max FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(read(spark, sf_dir, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 200")
def rolling_last_n(spark, sf_dir):
    return metrics.last_n(read(spark, sf_dir, "events"), 200, "user_id", order=("ts", "event_id")).select("user_id", "event_id", "place")


@query("WITH g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000 AS gap FROM events) SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= 60000) AS sent, count(*) FILTER (gap < 60000) AS canceled FROM g GROUP BY 1")
def debounce_sessions(spark, sf_dir):
    """Requests that a one-minute debounce would send and cancel, by user."""
    found = metrics.debounced(read(spark, sf_dir, "events"), "user_id", "ts", 60_000, "event_id")
    return found.groupBy("user_id").agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("canceled"))


@query(f"WITH {SQL_EVENTS} SELECT user_id, count(*) FILTER (type = 'request_scheduled') AS requests, count(*) FILTER (type = 'ghost_shown') AS ghosts, count(*) FILTER (type = 'ghost_accepted') AS accepts, count(*) FILTER (type = 'completion_reverted') AS reverts, count(*) FILTER (type = 'stale_response_dropped') AS stale_drops, count(*) FILTER (starts_with(type, 'ghost_dismissed')) AS dismissals FROM e GROUP BY 1")
def completion_funnel(spark, sf_dir):
    return metrics.funnel(metric_events(spark, sf_dir), "user_id")


@query("SELECT conv_id, turn, (sum(changed) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS version FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AND text IS DISTINCT FROM lag(text) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS changed FROM conversations)")
def document_versions(spark, sf_dir):
    """Turns of a conversation as snapshots of one text."""
    return metrics.versions(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "version")


SQL_CONTEXT = "c AS (SELECT conv_id, turn, text, length(text) // 2 AS mid FROM conversations), k AS (SELECT *, substr(substr(text, 1, mid), greatest(mid - 2000 + 1, 1), 2000) AS before, substr(text, mid + 1, 300) AS after FROM c)"


@query(rf"WITH {SQL_CONTEXT} SELECT conv_id, turn, before AS context_before, after AS context_after, regexp_extract(before, '[^\n\r]*\z') AS current_line, length(before) AS cursor_offset FROM k")
def context_window(spark, sf_dir):
    """What stands before and after the middle of each turn."""
    found = completion.context(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("c")).select("conv_id", "turn", "c.context_before", "c.context_after", "c.current_line", F.col("c.cursor_offset").cast("long").alias("cursor_offset"))


def follow_ups(spark, sf_dir):
    """Each turn before the cursor, and as a completion its last line with what comes next."""
    turns = read(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    before = completion.last(F.col("text"), F.lit(completion.BEFORE))
    return turns.select("conv_id", "turn", before.alias("before"), F.concat(completion.current_line(F.col("text")), F.lit(" "), after).alias("proposal")).where("proposal is not null")


SQL_FOLLOW = rf"f AS (SELECT * FROM (SELECT conv_id, turn, right(text, {completion.BEFORE}) AS before, regexp_extract(text, '[^\n\r]*\z') || ' ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS proposal FROM conversations) WHERE proposal IS NOT NULL)"
SQL_OVERLAP = "coalesce(list_max(list_filter(range(1, least(length(before), length(proposal)) + 1), lambda n: right(before, n) = left(proposal, n))), 0)"


@query(f"WITH {SQL_FOLLOW} SELECT conv_id, turn, {SQL_OVERLAP} AS overlap FROM f")
def overlap_trim(spark, sf_dir):
    """How much of a proposed completion repeats what stands before the cursor."""
    return follow_ups(spark, sf_dir).select("conv_id", "turn", completion.overlap(F.col("before"), F.col("proposal")).cast("long").alias("overlap"))


@query(f"WITH {SQL_FOLLOW}, p AS (SELECT *, list_min(list_filter([strpos(proposal, '. '), strpos(proposal, '?')], lambda x: x > 0)) AS stop FROM f) SELECT conv_id, turn, CASE WHEN stop IS NULL THEN proposal ELSE substr(proposal, 1, stop - 1) END AS kept FROM p")
def stop_sequences(spark, sf_dir):
    stops = F.array(F.lit(". "), F.lit(""), F.lit("?"))
    return follow_ups(spark, sf_dir).select("conv_id", "turn", completion.stopped(F.col("proposal"), stops).alias("kept"))


@query(rf"""WITH {SQL_FOLLOW}, a AS (SELECT *, CASE WHEN strpos(proposal, '. ') > 0 THEN substr(proposal, 1, strpos(proposal, '. ') - 1) ELSE proposal END AS s FROM f),
b AS (SELECT *, substr(s, {SQL_OVERLAP.replace('proposal', 's')} + 1) AS t FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\s+\z', ''), '\A\n+', '') AS u FROM b),
d AS (SELECT *, regexp_replace(u, '\A[ \t]+', '') AS rest FROM c),
e AS (SELECT *, CASE WHEN trim(u, E' \t\n\r') = '' THEN '' WHEN rest = u THEN u WHEN before <> '' AND NOT regexp_matches(before, '\s\z') AND regexp_matches(rest, '\A[A-Za-z0-9]') THEN ' ' || rest ELSE rest END AS v FROM d)
SELECT conv_id, turn, CASE WHEN trim(proposal, E' \t\n\r') = '' THEN '' ELSE regexp_replace(substr(v, 1, 220), '\s+\z', '') END AS completion FROM e""")
def sanitized_completions(spark, sf_dir):
    """Proposed completions as they may be shown."""
    found = completion.sanitized(F.col("proposal"), F.col("before"), F.array(F.lit(". ")))
    return follow_ups(spark, sf_dir).select("conv_id", "turn", found.alias("completion"))


@query("SELECT user_id::VARCHAR AS namespace, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def kv_latest(spark, sf_dir):
    """The last value of each user's key in a change log."""
    log = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("namespace"), F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("updated_at"))
    return rules.latest_values(log).select("namespace", "key", "value")


@query("SELECT doc_id, length(replace(replace(text, E'\\r\\n', E'\\n'), E'\\r', E'\\n')) AS n, md5(replace(replace(replace(replace(replace(replace(text, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS html_md5 FROM documents")
def pasted_text(spark, sf_dir):
    """Line ends made one kind: the length, and a digest of the whole text escaped for HTML."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n"), F.md5(spans.escaped(text).cast("binary")).alias("html_md5"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(text, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM documents")
def pasted_html(spark, sf_dir):
    """Line ends made one kind, and the whole text escaped for HTML."""
    return read(spark, sf_dir, "documents").select("doc_id", spans.escaped(F.regexp_replace("text", "\r\n?", "\n")).alias("html"))


SQL_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents),
w AS (SELECT *, regexp_replace(line, '\\A\\s+', '') AS t FROM l)"""


@query(rf"""WITH {SQL_LINES} SELECT doc_id, count(*) FILTER (t <> '' AND NOT starts_with(t, '#') AND (regexp_matches(t, '\A([$>]|PS\s+[^>]+>)\s+\S') OR (contains(t, ' ')
 AND lower(regexp_extract(t, '\A([A-Za-z][A-Za-z0-9_.-]*)(\s|\z)', 1)) IN ({", ".join(f"'{c}'" for c in protect.COMMANDS)})))) AS commands, count(*) FILTER (regexp_matches(line, '\]\([^)]*\z')) AS open_links,
 count(*) FILTER (len(regexp_extract_all(line, '`')) % 2 = 1) AS odd_backticks FROM w GROUP BY 1""")
def protected_places(spark, sf_dir):
    """Lines of each document that look like commands, end in an open link target, or have odd backticks."""
    line = F.col("line")
    found = protect.lines(read(spark, sf_dir, "documents"), "doc_id")
    return found.groupBy("doc_id").agg(
        F.count_if(protect.is_command(line)).alias("commands"), F.count_if(protect.in_link_target(line, F.length(line))).alias("open_links"),
        F.count_if(protect.odd_backticks(line)).alias("odd_backticks"),
    )


@query(r"""WITH t AS (SELECT conv_id, turn, text FROM conversations), p AS (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS n FROM t),
d AS (SELECT conv_id, turn, n AS "offset", regexp_replace(regexp_replace(substr(text, 1, n), '\s+\z', ''), '[.,!?;:)\]}]+\z', '') AS before FROM p WHERE substr(text, n, 1) IN (' ', chr(10), chr(9), '.', ',', '!', '?', ';', ':', ')', ']', '}')),
f AS (SELECT *, regexp_extract(before, '[^\s,!?;()\[\]{}]*\z') AS token FROM d)
SELECT conv_id, turn, count(*) AS delimiters, count(*) FILTER (token <> '') AS tokens, sum(length(token))::BIGINT AS characters FROM f GROUP BY 1, 2""")
def replayed_keystrokes(spark, sf_dir):
    """Every delimiter typed in conversations, with the token it completes."""
    found = tokens.replayed_tokens(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("delimiters"), F.count("token").alias("tokens"), F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("characters"))


@query(rf"""WITH {SQL_PLACED}, m AS (SELECT doc_id, start AS a, start + 12 AS b FROM ends WHERE starts_with(run, 'T')) SELECT e.doc_id, count(*) AS n FROM edits e JOIN m ON e.doc_id = m.doc_id AND e.start < m.b AND m.a < e.end_ GROUP BY 1""")
def overlapping_marks(spark, sf_dir):
    """Corrections that overlap the twelve characters after a capital T."""
    docs = read(spark, sf_dir, "documents")
    capital = tokens.placed_runs(docs, "doc_id").where(F.col("run").startswith("T")).select("doc_id", "start", (F.col("start") + 12).alias("end"))
    return marks.overlapping(user_edits(spark, sf_dir), capital).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"""WITH {SQL_PLACED}, swapped AS (SELECT e.doc_id, e.pos, CASE WHEN d.original IS NULL THEN e.run ELSE '<mark class="blue">' || d.original || '</mark>' || substr(e.run, length(d.original) + 1) END AS piece, d.original IS NOT NULL AS hit,
 replace(replace(replace(replace(e.run, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS plain FROM ends e LEFT JOIN edits d USING (doc_id, pos))
SELECT doc_id, string_agg(CASE WHEN hit THEN piece ELSE plain END, '' ORDER BY pos) AS html FROM swapped GROUP BY 1 HAVING count(*) FILTER (hit) > 0""")
def rendered_marks(spark, sf_dir):
    """Documents as HTML with a mark on each word that a rule would correct."""
    spots = user_edits(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.lit("blue").alias("kind"))).alias("marks"))
    return read(spark, sf_dir, "documents").join(spots, "doc_id").select("doc_id", marks.rendered(F.col("text"), F.col("marks")).alias("html"))


@query(rf"WITH {SQL_TOKENS}, {SQL_DICTIONARY} SELECT load_order, word, frequency, flags FROM dictionary")
def blob_roundtrip(spark, sf_dir):
    """The corpus dictionary, written as a binary file and read back."""
    words = corpus_dictionary(spark, sf_dir)
    packed = blob.blobs(words.withColumn("name", F.lit("corpus"))).select(F.col("name").alias("path"), "content")
    return blob.decoded(packed, strict=True).select("load_order", "word", "frequency", "flags")
