"""Mixing to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier over hashed words, counted from a labelled table, gives
each document the posterior of every domain.  Rates ``r >= 0`` (at most ``most``)
are then fitted so that the expected token total of each domain,
``sum(r * tokens * posterior)``, matches its target share of the largest total at
which all can.  Posteriors overlap, so that total is part of the problem: it is the
multiplier of the dual, whose gradient is the misfit, and a document's rate is its
posteriors' product with the dual's weights, projected into 0..most.  From those rates
projected gradient steps on the sum of squared misfits go on until every total is
within ``TOLERANCE``.  Gradients and curvature are a few sums, so each round is one
aggregate over (tokens, posteriors) and nothing is shuffled.

Posteriors are computed within each row, so rows need no key: each has its own rate.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, packed, staged, unpacked

#: Hash buckets of words.
BUCKETS = 4096
#: Labelled documents of each domain that are counted: about so many, picked by a hash of doc_id.
SAMPLE = 4000
#: Most projected gradient steps; a mix mostly takes 10 to 30.
ROUNDS = 150
#: Steps after which rates are written.
STAGED = 8
#: Part of the largest total that is asked for: at the largest itself nearly all rates stand at a bound, and steps get short.
INSIDE = 0.999
#: Relative misfit at which rounds end.
TOLERANCE = 1e-4
#: Most rounds of the fit for the largest total; it mostly needs 10 to 30.
MOST_ROUNDS = 80
#: How much the fit gives up of the total for rates between nought and ``most``; small is little.
SMOOTH = 0.3
#: Least part of all tokens that a total must have; below, the posteriors cannot meet the targets.
LEAST_TOTAL = 1e-4
#: How sharply words decide: a text's log likelihood is its mean for one word times this.
SHARPNESS = 100.0
UNIT = 1_000_000


def buckets(text: Column) -> Column:
    """The bucket of each word of a text, an empty array for null."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\s\p{Punct}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> list[list[float]]:
    """For each domain, the log probability of every bucket; uniform where a domain has no document.

    ``labelled``: (doc_id, domain); other domains and nulls are ignored.  The driver
    gets at most BUCKETS rows for each domain.
    """
    marks = labelled.select("doc_id", "domain").where(F.col("domain").isin(domains)).distinct()
    many = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    share = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(min(1.0, sample / max(1, many.get(d, 0)))))])
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("mixing sample"), "doc_id"), F.lit(UNIT)) < share[F.col("domain")] * UNIT)
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    counts = known.select("domain", F.explode(buckets(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").count().collect()
    table = {d: [1.0] * BUCKETS for d in domains}
    for r in counts:
        table[r["domain"]][r["bucket"]] += r["count"]
    return [[math.log(c / sum(table[d])) for c in table[d]] for d in domains]


def class_priors(labelled: DataFrame, domains: list[str]) -> list[float]:
    """Each domain's share of the labelled documents, one added to each."""
    many = {r["domain"]: r["count"] + 1 for r in labelled.where(F.col("domain").isin(domains)).groupBy("domain").count().collect()}
    counts = [many.get(d, 1) for d in domains]
    return [c / sum(counts) for c in counts]


def posteriors(docs: DataFrame, domains: list[str], logs: list[list[float]], *keep: str, priors: list[float] | None = None) -> DataFrame:
    """For every row the columns ``keep``, tokens (words) and p, the array of posteriors under ``priors`` (else equal ones); texts without words get equal ones."""
    before = [math.log(x) for x in priors or [1.0] * len(domains)]
    # One string for each table, which the optimizer folds to a constant array.
    constant = [F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") for values in logs]
    cut = docs.select(*keep, buckets(F.col("text")).alias("buckets"))
    total = lambda values: F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get(values, b))
    sums = cut.select(*keep, F.size("buckets").cast("long").alias("tokens"), *[total(values).alias(f"s{k}") for k, values in enumerate(constant)])
    scaled = [F.when(F.col("tokens") > 0, F.col(f"s{k}") / F.col("tokens") * SHARPNESS + F.lit(b)).otherwise(0.0) for k, b in enumerate(before)]
    top = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
    raised = F.array(*[F.exp(s - top) for s in scaled])
    p = F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    # Exploding one value has it computed once: a filter by a rate would else be pushed down and compute all this for each use.
    found = sums.select(*keep, "tokens", raised.alias("e")).select(*keep, F.explode(F.array(F.struct("tokens", p.alias("p")))).alias("found"))
    return found.select(*keep, "found.tokens", "found.p")


def clipped(r: Column, push: list[Column], most: float) -> Column:
    """One projected step: along the posteriors by the push, and back into 0..most."""
    for k, x in enumerate(push):
        r = r + x * F.col("p")[k]
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r))


def rate_of(steps: list[list[float]], most: float = 1.0) -> Column:
    """The rate of a row with posteriors p after ``steps`` (a push by domain each) from a rate of ``most``."""
    if not steps:
        return F.lit(float(most))
    constant = F.split(F.lit(",".join(repr(float(x)) for push in steps for x in push)), ",").cast("array<double>")
    width = len(steps[0])
    at = F.transform(F.sequence(F.lit(0), F.lit(len(steps) - 1)), lambda k: F.slice(constant, k * width + 1, F.lit(width)))
    return F.aggregate(at, F.lit(float(most)), lambda r, push: clipped(r, [push[k] for k in range(width)], most))


@dataclass
class Fit:
    """Rates by steps (a push by domain each), the domain totals wanted and those reached."""

    steps: list[list[float]]
    want: list[float]
    reached: list[float]
    most: float

    @property
    def rate(self) -> Column:
        return rate_of(self.steps, self.most)


def fit(mass: DataFrame, want: list[float], most: float = 1.0, rounds: int = ROUNDS) -> Fit:
    """Rates for the rows of ``mass`` (tokens, p) whose domain totals are ``want``, by projected gradient steps from rates of ``most``.

    Misfits are squared in the metric of all rows' second moments, sum(tokens p p').  A step
    scales the gradient by the moments of the rows whose rates are free to move, damped by
    those of all rows; one that does not lessen the squares is taken back and damped more.
    Ends where every total is met, or no step lessens the squares any more.  Each step is one
    aggregate over all rows; rates are written every STAGED steps.
    """
    size = len(want)
    pairs = [(a, b) for a in range(size) for b in range(a, size)]

    def measure(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals by domain, and the moments of free rows and of all."""
        moment = lambda a, b: F.col("tokens") * F.col("p")[a] * F.col("p")[b]
        free = (F.col("r") > 0) & (F.col("r") < most)
        asked = [F.sum(F.col("r") * F.col("tokens") * F.col("p")[k]) for k in range(size)]
        asked += [F.sum(F.when(free, moment(a, b))) for a, b in pairs] + [F.sum(moment(a, b)) for a, b in pairs]
        found = [float(x or 0.0) for x in df.agg(*[c.alias(f"c{i}") for i, c in enumerate(asked)]).first()]
        square = np.zeros((2, size, size))
        for i, (a, b) in enumerate(pairs * 2):
            square[i // len(pairs), a, b] = square[i // len(pairs), b, a] = found[size + i]
        return np.array(found[:size]), square[0], square[1]

    goal = np.array(want)
    frame = mass.select("tokens", "p", F.lit(float(most)).alias("r"))
    reached, _, every = measure(frame)
    inverse, scale, damping = np.linalg.pinv(every), every, 1.0
    squares = lambda totals: float((goal - totals) @ inverse @ (goal - totals))
    steps: list[list[float]] = []
    kept = None
    for _ in range(rounds):
        if not missed(want, reached.tolist()) or damping > 1e12:
            break
        push = (np.linalg.pinv(scale + damping * every) @ (goal - reached)).tolist()
        trial = frame.select("tokens", "p", clipped(F.col("r"), [F.lit(float(x)) for x in push], most).alias("r"))
        totals, free, _ = measure(trial)
        if squares(totals) >= squares(reached) * (1 - 1e-9):
            damping *= 8
            continue
        frame, reached, scale, damping = trial, totals, free, max(damping / 4, 1e-9)
        steps.append(push)
        if len(steps) % STAGED == 0:
            frame, old = staged(frame, "rates"), kept
            kept = frame
            if old is not None:
                drop_staged(old)
    if kept is not None:
        drop_staged(kept)
    return Fit(steps, want, reached.tolist(), most)


def largest_totals(mass: DataFrame, targets: dict[str, float], most: float = 1.0, rounds: int = MOST_ROUNDS) -> list[float]:
    """The domain totals of the largest mix, nearly, that rates of 0..most can bring to the shares of ``targets``.

    Minimises ``sum(tokens * phi(y . p))`` over weights y with ``shares . y = 1``, by
    Newton's method with damped steps, where phi(u) is the maximum of
    ``r * u - SMOOTH * r * r / 2`` over r in 0..most: at the minimum, the totals of the
    rates that give it are proportional to the shares.  A domain without any mass is left out.
    Only the totals are used; the rates come from :func:`fit`.
    """
    size = len(targets)
    sums = mass.agg(*[F.sum(F.col("tokens") * F.col("p")[k]).alias(f"t{k}") for k in range(size)]).first()
    have = np.array([float(s or 0.0) for s in sums])
    shares = np.array(list(targets.values()), dtype=float) * (have > 0)
    if shares.sum() <= 0:
        return [0.0] * size
    shares /= shares.sum()
    pairs = [(a, b) for a in range(size) for b in range(a, size)]

    def rate(y: np.ndarray) -> tuple[Column, Column]:
        u = sum((F.lit(float(x)) * F.col("p")[k] for k, x in enumerate(y)), F.lit(0.0))
        return u, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), u / SMOOTH))

    def measure(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        u, r = rate(y)
        seen = mass.select("tokens", "p", u.alias("u"), r.alias("r"))
        free = F.when((F.col("r") > 0) & (F.col("r") < most), F.col("tokens")).otherwise(0)
        value = F.sum(F.col("tokens") * (F.col("r") * F.col("u") - SMOOTH / 2 * F.col("r") * F.col("r")))
        totals = [F.sum(F.col("tokens") * F.col("r") * F.col("p")[k]) for k in range(size)]
        bends = [F.sum(free * F.col("p")[a] * F.col("p")[b]) for a, b in pairs]
        found = [float(x or 0.0) for x in seen.agg(*[c.alias(f"c{i}") for i, c in enumerate([value, *totals, *bends])]).first()]
        curve = np.zeros((size, size))
        for (a, b), x in zip(pairs, found[1 + size :]):
            curve[a, b] = curve[b, a] = x / SMOOTH
        return found[0], np.array(found[1 : 1 + size]), curve

    y, all_tokens = np.ones(size), have.sum()
    value, reached, curve = measure(y)
    damping = 0.01
    for _ in range(rounds):
        total = reached.sum()
        if total <= 0 or np.abs(reached - shares * total).max() < TOLERANCE * total * shares[shares > 0].min():
            break
        system = np.zeros((size + 1, size + 1))  # the step stays within shares . y = 1
        system[:size, :size] = curve + np.eye(size) * damping * all_tokens / SMOOTH
        system[:size, size] = system[size, :size] = shares
        step = np.linalg.solve(system, np.append(-reached, 0.0))[:size]
        at_trial = measure(y + step)
        if at_trial[0] <= value + 1e-4 * float(reached @ step):
            y, (value, reached, curve), damping = y + step, at_trial, max(damping / 10, 1e-9)
        else:
            damping *= 8
    return (shares * reached.sum()).tolist()


def missed(want: list[float], reached: list[float], tolerance: float = TOLERANCE) -> bool:
    """Whether a domain's total is off its target by more than ``tolerance`` of that."""
    return any(abs(w - r) > tolerance * w for w, r in zip(want, reached))


class Mixer:
    """A fitted mix: the classifier, the rate of a row, and the totals wanted and reached by domain."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float = 1.0, sample: int = SAMPLE):
        self.targets = targets
        domains = list(targets)
        self.logs, self.priors = learn(docs, labelled, domains, sample), class_priors(labelled, domains)
        self.mass = staged(self.judged(docs, "doc_id"), "mass")
        tokens = self.mass.agg(F.sum("tokens")).first()[0] or 0
        want = [INSIDE * x for x in largest_totals(self.mass, targets, most)]
        feasible = sum(want) >= LEAST_TOTAL * tokens
        found = fit(self.mass, want, most) if feasible else Fit([], want, want, most)
        self.rate, self.steps, self.want, self.reached = found.rate, len(found.steps), found.want, found.reached
        if tokens and (not feasible or missed(self.want, self.reached, TOLERANCE)):
            warnings.warn(f"mixing: wanted {dict(zip(domains, self.want))}, reached {dict(zip(domains, self.reached))} of {tokens} tokens after {self.steps} steps", stacklevel=3)
        self.kept = F.col("draw") < self.rate

    def judged(self, docs: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` of each row with tokens, p and draw, by which its rate decides."""
        draw = F.pmod(F.xxhash64(F.lit("mixing draw"), F.col("doc_id"), F.col("text").cast("string")), F.lit(UNIT)) / UNIT
        return posteriors(docs.withColumn("draw", draw), list(self.targets), self.logs, *keep, "draw", priors=self.priors)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float = 1.0, sample: int = SAMPLE) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, tokens, p, rate, kept, wanted and reached.

    ``kept`` draws by a hash of doc_id and text: a rate of 0.3 keeps three of ten, and equal
    rows share their lot.  ``wanted`` and ``reached`` are the domains' expected token totals,
    the same in every row.  A null text has no tokens and equal posteriors; a null doc_id
    is judged as any other; other columns are ignored; an empty table gives no rows.
    Warns where the posteriors cannot meet the targets; if hardly a token could stay
    (no labels, say), every rate is ``most``.
    """
    mixer = Mixer(docs.select("doc_id", "text"), labelled, targets, most, sample)
    totals = [F.array(*map(F.lit, map(float, x))).alias(n) for n, x in (("wanted", mixer.want), ("reached", mixer.reached))]
    return mixer.mass.select("doc_id", "tokens", "p", mixer.rate.alias("rate"), mixer.kept.alias("kept"), *totals)


#: Domains of the labels table, and what share of tokens each should have.
TARGETS = {"clean": 0.95, "toxic": 0.03, "low": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the quality and toxic marks; rows with a null mark have no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


def mix_labelled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """:func:`mix` by the marks of ``labels``, with a column for each posterior and total."""
    mixed = mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), label_domains(labels), targets)
    share = lambda c: [F.round(F.try_divide(F.col(c)[k], F.aggregate(c, F.lit(0.0), lambda a, b: a + b)), 9).alias(f"{c}_{d}") for k, d in enumerate(targets)]
    return mixed.select("doc_id", "tokens", *[F.round(F.col("p")[k], 9).alias(f"p_{d}") for k, d in enumerate(targets)], F.round("rate", 9).alias("rate"), "kept", *share("wanted"), *share("reached"))


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with all their columns."""
    rows = packed(docs).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    mixer = Mixer(rows.select("doc_id", "text"), label_domains(labels), targets)
    return unpacked(mixer.judged(rows, "row", "text").where(mixer.kept), docs.columns)
