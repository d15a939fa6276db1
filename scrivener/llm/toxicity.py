"""Toxicity scores by a counterfactually regularised linear classifier.

Features are the presence in a text of words and of word beginnings (for inflected
forms).  The vocabulary holds those whose labelled document counts differ
significantly between the classes, and the identity terms.  Each labelled sentence
with an identity term has counterfactuals in which the term is swapped for the
others of its group; so has a bare mention of each term, whatever the sample holds.
The training loss adds ``penalty`` times, for each group, the mean squared change of
the score under a swap, so mentions of a group as such move no score.

Identity terms are a parameter: groups listed for some languages, and groups mined
from the corpus, for languages that no list knows: common words that both classes use
alike.  Vocabulary and weights come from a bounded sample of the labelled documents,
``SAMPLE`` of each class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, staged

#: Labelled documents of each class that are learned from: about so many, picked by a hash of doc_id.
SAMPLE = 6000
#: Features at most, the most significant first; squared z-score that a feature must reach.
VOCABULARY = 2000
SIGNIFICANT = 16.0
#: Labelled documents that a feature must stand in.
LEAST_DOCS = 5
BEGINNINGS = (4, 5)
PENALTY = 10.0
RIDGE = 1e-4
#: Identity terms that swap with the others of their group (a parameter), in four languages.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "hispanic", "arab", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "citizens"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "bürger"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "citoyens"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)
#: Mined terms at most, and how many of neighbouring frequency make a group.
MINED, GROUP = 32, 4
#: A mined term: letters, the share of each class's documents that has it, and its squared z-score at most.
MINED_LETTERS, MINED_SHARE, ALIKE = 4, 0.005, 1.0
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def terms(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """The words, and with a tilde the beginnings of those that are longer."""
    return words.union(*[{w[:k] + "~" for w in words if len(w) > k} for k in BEGINNINGS])


def swaps(text: str | None, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """Counterfactuals of a text's sentences: for each, the features it gains, those it loses, and its group's number."""
    partners = {t: (k, g) for k, g in enumerate(groups) for t in g}
    if not partners.keys() & terms(text):
        return []
    found = []
    for sentence in SENTENCE.findall(text or ""):
        own = terms(sentence)
        for term in sorted(own & partners.keys()):
            rest, had = features(own - {term}), features({term})
            k, group = partners[term]
            for other in group:
                if other != term:
                    new = features({other})
                    found.append((tuple(sorted(new - had - rest)), tuple(sorted(had - new - rest)), k))
    return found


def swap_rows(batches: Iterator[pa.RecordBatch], groups: tuple[tuple[str, ...], ...]) -> Iterator[pa.RecordBatch]:
    """Texts to (gains, loses, group, n), counted within each batch."""
    names, kinds = ["gains", "loses", "group", "n"], (pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int64())
    for batch in batches:
        count = Counter(s for text in batch.column("text").to_pylist() for s in swaps(text, groups))
        columns = zip(*[(*s, n) for s, n in count.items()]) if count else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (word, all, toxic) document counts of a batch."""
    for batch in batches:
        count: dict[str, list[int]] = {}
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            for w in features(terms(text)):
                row = count.setdefault(w, [0, 0])
                row[0] += 1
                row[1] += label
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([r[0] for r in count.values()], pa.int64()), pa.array([r[1] for r in count.values()], pa.int64())], names=["word", "n", "n_toxic"])


def fit(places: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, penalty: float = PENALTY, rounds: int = 400, shares: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss, ridge and the counterfactual penalty.

    ``places[i]``: features of document i, its label ``y[i]``; ``pairs[k]``: features
    that swap k gains and loses, ``shares[k]``: its weight in the penalty (else equal
    ones that add up to one).  Accelerated gradient descent; classes weigh the same.
    """
    def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([c for x in lists for c in x], dtype=np.int64)

    rows, cols = flat(places)
    swap, swap_cols = flat([list(g) + list(x) for g, x in pairs])
    sign = np.array([v for g, x in pairs for v in [1.0] * len(g) + [-1.0] * len(x)])
    shares = np.full(len(pairs), 1 / max(1, len(pairs))) if shares is None else shares
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def penalised(w: np.ndarray) -> np.ndarray:
        change = np.bincount(swap, sign * w[swap_cols], len(pairs)) * shares * (2 * penalty)
        return np.bincount(swap_cols, sign * change[swap], size)

    # Steps by what bounds the curvature: of the log loss, a quarter of its weighted Gram matrix's largest; of
    # the penalty, a sum for each feature, so that a strict penalty slows the features in swaps only.
    probe, bend = np.ones(size + 1) / np.sqrt(size + 1), 1.0
    for _ in range(60):
        z = (np.bincount(rows, probe[cols], len(places)) + probe[-1]) * share / 4
        new = np.append(np.bincount(cols, z[rows], size), z.sum())
        bend = float(np.linalg.norm(new))
        probe = new / max(bend, 1e-300)
    stiff = np.bincount(swap_cols, (shares * [len(g) + len(x) for g, x in pairs])[swap], size) * (2 * penalty) if pairs else 0
    step, step_b = 1 / (1.1 * bend + RIDGE + stiff), 1 / (1.1 * bend + RIDGE)
    w, b = np.zeros(size), 0.0
    look, look_b = w, b
    for k in range(rounds):
        z = np.bincount(rows, look[cols], len(places)) + look_b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.bincount(cols, error[rows], size) + RIDGE * look + (penalised(look) if pairs else 0)
        new, new_b = look - step * grad, look_b - step_b * error.sum()
        look, look_b = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    return w, float(b)


class Model:
    """Weights of features and an intercept; ``swaps``: how many counterfactuals the penalty saw, ``terms``: the groups in use."""

    def __init__(self, weights: dict[str, float], intercept: float, swaps: int = 0, terms: tuple[tuple[str, ...], ...] = ()):
        self.weights, self.intercept, self.swaps, self.terms = weights, intercept, swaps, terms

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[w] for w in sorted(self.weights.keys() & features(terms(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def learn(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, penalty: float = PENALTY, sample: int = SAMPLE, mined: int = MINED) -> Model:
    """Learns from labelled rows of ``docs`` (doc_id, text) that are not held out.

    A label other than 0 or 1, or null, is no label; one with a null text counts as
    a text without words; of rows that share a doc_id the text with the smallest
    hash is learned from.  With no label of either class every score is 0, with
    labels of one class only that class's share decides.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    marks = marks.where(~held_out("doc_id")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    many = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not many.get(0) or not many.get(1):
        return Model({}, 30.0 if many.get(1) else -700.0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / many[1])).otherwise(min(1.0, sample / many[0]))
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # The sample is bounded, so its ids go to the texts, not the texts to them.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    known = staged(known.groupBy("doc_id", "toxic").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text")).select("doc_id", "text", "toxic"), "labelled")
    counts = known.select("text", "toxic").mapInArrow(word_rows, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    totals = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    n0, n1 = max(1, totals.get(0, 0)), max(1, totals.get(1, 0))
    a, b = F.col("n_toxic"), F.col("n") - F.col("n_toxic")
    common = F.col("n") / (n0 + n1)
    z2 = (a / n1 - b / n0) * (a / n1 - b / n0) / (F.greatest(common * (1 - common), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    counts = staged(counts.select("word", "n", z2.alias("z2"), F.least(a / n1, b / n0).alias("rarer")), "words")
    alike = counts.where((F.col("z2") < ALIKE) & (F.col("rarer") >= MINED_SHARE) & F.col("word").rlike(rf"\A\p{{L}}{{{MINED_LETTERS},}}\z"))
    listed = {t for g in groups for t in g}
    found = [r["word"] for r in alike.where(~F.col("word").isin(list(listed))).orderBy(F.col("n").desc(), "word").limit(mined).select("word").collect()]
    groups = (*groups, *(tuple(found[k : k + GROUP]) for k in range(0, len(found), GROUP) if len(found[k : k + GROUP]) > 1))
    best = counts.where((F.col("n") >= LEAST_DOCS) & (F.col("z2") >= SIGNIFICANT)).orderBy(F.col("z2").desc(), "word").limit(VOCABULARY).select("word").collect()
    vocabulary = {w: k for k, w in enumerate(sorted({r["word"] for r in best} | features({t for g in groups for t in g})))}
    places = lambda found: sorted(vocabulary[w] for w in found if w in vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [places(features(terms(text))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "toxic", "own"])

    found = known.mapInArrow(rows, "doc_id long, toxic int, own array<int>").collect()  # the bounded sample
    found.sort(key=lambda r: (r["doc_id"], r["toxic"], r["own"]))
    # Equal swaps are counted, so what comes back is bounded by the terms and the words beside them that begin alike.
    seen = known.select("text").mapInArrow(lambda it: swap_rows(it, groups), "gains array<string>, loses array<string>, group int, n long")
    counted = Counter({(tuple(r["gains"]), tuple(r["loses"]), r["group"]): r["n"] for r in seen.groupBy("gains", "loses", "group").agg(F.sum("n").alias("n")).collect()})
    counted.update(s for g in groups for t in g for s in swaps(t, groups))
    pairs = sorted((k, places(g), places(x), n) for (g, x, k), n in counted.items())
    of_group = np.bincount([k for k, *_ in pairs], [n for *_, n in pairs], len(groups)) if pairs else np.zeros(0)
    shares = np.array([n / of_group[k] for k, _, _, n in pairs])
    w, intercept = fit([r["own"] for r in found], np.array([r["toxic"] for r in found], dtype=float), [(g, x) for _, g, x, _ in pairs], len(vocabulary), penalty, shares=shares)
    return Model({t: float(w[k]) for t, k in vocabulary.items()}, intercept, sum(counted.values()), groups)


def score(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, by :func:`learn` from the rows that are not held out.

    Null and empty texts have no words and get the score of the intercept alone.
    Rows that repeat a doc_id are each scored by their text; a null doc_id is not held
    out; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = learn(docs, labels, groups, penalty)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words and the identity terms

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
