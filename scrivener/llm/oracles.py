"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .phrases import LEAST, LISTED
from .secrets import RULES
from .sentence_spans import MARKS, SENTENCES, WORDS as RUN_WORDS
from .topk import K, QUERY_EVERY, SCALE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(w[k:k + l - 1], ' ') AS win FROM bk),
dk AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d JOIN (SELECT DISTINCT l FROM bw) ON len(w) >= l),
dw AS (SELECT doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') AS win FROM dk),
hits AS (SELECT doc_id, k, l, item FROM dw JOIN bw USING (win, l)),
places AS (SELECT DISTINCT doc_id, unnest(range(k, k + l)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

TOP_K = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.r <> c.r),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {K}"""


def _matches(k: int) -> str:
    rule = RULES[k]
    pattern = rule.pattern.replace("'", "''")
    return f"SELECT doc_id, {k} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {rule.part}) AS ps FROM d"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(map(_matches, range(len(RULES))))}),
u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT doc_id, place, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS a, length(ms[i]) AS n FROM u WHERE length(ps[i]) >= least),
s AS (SELECT doc_id, place, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM p),
g AS (SELECT doc_id, string_agg(span, ',' ORDER BY a, place) AS spans, string_agg(span, ',' ORDER BY a, place) FILTER (place < 3) AS base,
 count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""

#: Cumulative words give each sentence's shortest run by nearest-match joins; stretches are gaps and islands.
SPANS = rf"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, piece, regexp_extract_all(lower(piece), '[\p{{L}}\p{{N}}_]+') AS words FROM s),
c AS (SELECT *, len(words) AS n, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS past FROM w),
ends AS (SELECT doc_id, upto, i + 1 AS e FROM c WHERE n > 0),
starts AS (SELECT doc_id, upto - n AS before, i FROM c WHERE n > 0),
near AS (SELECT c.doc_id, c.i AS a, greatest(ends.e, c.i + {SENTENCES}) AS limit_ FROM c ASOF JOIN ends ON c.doc_id = ends.doc_id AND c.upto - c.n + {RUN_WORDS} <= ends.upto WHERE c.n > 0),
fwd AS (SELECT near.doc_id, near.a, ends.e AS b FROM near ASOF JOIN ends ON near.doc_id = ends.doc_id AND near.limit_ <= ends.e),
far AS (SELECT c.doc_id, least(c.i + 1 - {SENTENCES}, starts.i) AS limit_, c.i + 1 AS b FROM c ASOF JOIN starts ON c.doc_id = starts.doc_id AND c.upto - {RUN_WORDS} >= starts.before WHERE c.n > 0 AND c.i + 1 >= {SENTENCES}),
bwd AS (SELECT far.doc_id, starts.i AS a, far.b FROM far ASOF JOIN starts ON far.doc_id = starts.doc_id AND far.limit_ >= starts.i),
r AS (SELECT DISTINCT doc_id, a, b FROM (SELECT * FROM fwd UNION ALL SELECT * FROM bwd)),
t AS (SELECT r.doc_id, r.a, r.b, string_agg(array_to_string(w.words, ' '), ' ' ORDER BY w.i) FILTER (len(w.words) > 0) AS run FROM r JOIN w ON w.doc_id = r.doc_id AND w.i BETWEEN r.a AND r.b - 1 GROUP BY 1, 2, 3),
h AS (SELECT *, first_value(doc_id) OVER (PARTITION BY run ORDER BY doc_id, a) AS first_doc, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM t),
later AS (SELECT doc_id, a, b, first_doc FROM h WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM later),
isl AS (SELECT c.doc_id, c.i, c.n, c.past, length(c.piece) AS size, c.i - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.i) AS g FROM c JOIN cov ON c.doc_id = cov.doc_id AND c.i = cov.i),
st AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b, min(past - size) AS x, max(past) AS y FROM isl GROUP BY doc_id, g),
gone AS (SELECT doc_id, unnest(range(a, b)) AS i FROM st),
kept AS (SELECT c.doc_id, coalesce(string_agg(piece, '' ORDER BY c.i) FILTER (gone.i IS NULL), '') AS text, count(*) AS n_sentences, count(gone.i) AS n_removed FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.i = gone.i GROUP BY 1),
span AS (SELECT doc_id, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY a) AS spans FROM st GROUP BY 1),
of AS (SELECT doc_id, string_agg(CAST(first_doc AS VARCHAR), ',' ORDER BY first_doc) AS first_docs FROM (SELECT DISTINCT later.doc_id, first_doc FROM later JOIN st ON later.doc_id = st.doc_id AND later.a >= st.a AND later.a < st.b) GROUP BY 1)
SELECT kept.doc_id, kept.text, n_sentences, n_removed, spans, first_docs FROM kept JOIN span USING (doc_id) JOIN of USING (doc_id)"""

#: A phrase of m words has m - 1 cuts; a containing phrase one word longer is as frequent as any that contains it.
COLLOCATIONS = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM p JOIN (SELECT unnest(range(1, 6)) AS size) ON len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {LEAST}),
inside AS (SELECT lang, part AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[:size - 1], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE size > 2) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a),
cut AS (SELECT *, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
s AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, n, k, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
 FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN n ON n.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM top WHERE rank <= {LISTED}"""

HARD_NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.r <> c.r),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.r, nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
 FROM p JOIN s ON p.r = s.r AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLES = {"op13_hard_negatives": HARD_NEGATIVES, "op12_collocations": COLLOCATIONS, "op2_decontaminate": DECONTAMINATE, "op5_topk": TOP_K, "op6_sentence_spans": SPANS, "op8_secret_ledger": SECRETS}
