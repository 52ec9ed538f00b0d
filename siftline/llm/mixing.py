"""Mixing to target weights with soft membership of domains.

A classifier fitted on the labelled table (at most ``MOST_ROWS`` rows) gives each document the
posteriors of the domains ``good`` (quality 1, not toxic), ``poor`` (quality 0, not toxic) and
``toxic``. The expected tokens of a domain are the documents' tokens weighted by posterior and rate.
Rates are the numbers from 0 to the bound, if there is one, whose expected domain tokens meet the
targets, in the least-squares sense where they can't be met (the residual weighted by the inverse of the
domains' second-moment matrix), and among those the nearest to one in the metric of the documents' tokens.

Such a rate is 1 minus the product of the posteriors with one multiplier per domain, clipped. The
multipliers solve a convex dual problem, in which the distance from one weighs ``PULLS`` against the
residual: the problem is solved by Newton steps for the first of these weights, from there for the next, and
the last one's solution counts. A step needs one or two passes for sums over all documents, of one number
per domain and per pair of domains for each step length tried. A fit that doesn't converge within ``MOST_PASSES``
raises an error; ``Plan.expected`` has what the rates give, to be held against ``Plan.targets``.

Targets: the weights, scaled so that the domain which is scarcest against its weight keeps what it has
(no domain as a whole is repeated), or multiplied by ``total`` tokens if that is given.

Defined cases: a null or wordless text has no tokens, the mean posteriors (weighted by tokens) stand
for its own, and it counts for nothing in the totals; labels that are null or belong to no document
are not used; a domain without labelled rows has posteriors zero and its weight is left out; without
two labelled domains every rate is 1; repeated rows each have a rate, the same; of a labelled doc_id that is
repeated one text is fitted on; doc_ids may be null or of any type; an empty table gives an empty result;
other columns are never read by ``mix``, and kept by ``draw``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashed_lr as lr
from .shared import pieces, written

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.9, "poor": 0.05, "toxic": 0.05}
MOST_ROWS = 1500
RIDGE = 0.002
PULLS = 10.0 ** -np.arange(1, 9)
NEAR = 1e-6
MOST_PASSES = 100
LENGTHS = np.concatenate([[1.0], np.geomspace(0.9, 1e-6, 23)])


def domain_of(labels: DataFrame) -> DataFrame:
    """(id, label): 0 good, 1 poor, 2 toxic; a null toxic counts as 0."""
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    return labels.select(F.col("doc_id").alias("id"), label.alias("label"))


class Classifier(NamedTuple):
    model: lr.Model | None
    present: np.ndarray  # which domains have labelled rows


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Classifier:
    rows = lr.sample(docs, domain_of(labels), most)
    y = np.array([r["label"] for r in rows], int)
    present = np.isin(np.arange(len(DOMAINS)), y)
    if present.sum() < 2:
        return Classifier(None, present)
    x = lr.features_of([r["text"] for r in rows])
    return Classifier(lr.fit(x, y, len(DOMAINS), RIDGE), present)


def posteriors(classifier: Classifier, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((texts, domains), tokens): one-versus-rest probabilities brought to the sum of one."""
    x, tokens = lr.text_features(texts)
    p = lr.probabilities(classifier.model, x) * classifier.present + 1e-12
    return p / p.sum(1, keepdims=True), tokens


def _batches(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                for at in range(0, piece.num_rows, lr.ROWS):
                    part = piece.slice(at, lr.ROWS)
                    if shared.value.model is None:
                        p, tokens = np.full((part.num_rows, len(DOMAINS)), 1 / len(DOMAINS)), lr.text_features(part.column("__text"))[1]
                    else:
                        p, tokens = posteriors(shared.value, part.column("__text"))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), len(DOMAINS)).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(tokens), lists], [*keep, "__tokens", "__p"])

    return run


def with_posteriors(docs: DataFrame, classifier: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, by position as __k0, __k1 ..., with __tokens and __p."""
    names = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "__tokens long, __p array<double>"])
    return rows.mapInArrow(_batches(docs.sparkSession.sparkContext.broadcast(classifier), names), schema)


class Plan(NamedTuple):
    """What turns posteriors into rates: the multipliers, the bound, and the posteriors for texts without tokens."""

    steps: list[list[float]]  # the multipliers, or nothing where every rate is 1
    most_rate: float | None
    mean: list[float]
    have: list[float]
    targets: list[float]
    expected: list[float]  # each domain's tokens at these rates

    def rate(self) -> Column:
        """The rate, of a table with __tokens and __p."""
        if not self.steps:
            return F.lit(1.0)
        p = F.when(F.col("__tokens") > 0, F.col("__p")).otherwise(F.array(*map(F.lit, self.mean)))
        r = F.lit(1.0) - sum((p[k] * F.lit(g) for k, g in enumerate(self.steps[0])), F.lit(0.0))
        return F.greatest(F.lit(0.0), r if self.most_rate is None else F.least(F.lit(float(self.most_rate)), r))


def moments(tokens: np.ndarray, p: np.ndarray, multipliers: np.ndarray, most_rate: float | None) -> np.ndarray:
    """For each row of ``multipliers``: the expected tokens of the domains, and the second moments of the rates that aren't clipped."""
    out = []
    for m in multipliers:
        free = 1 - p @ m
        rate = np.clip(free, 0, most_rate)
        inner = tokens * (rate == free)
        out.append(np.concatenate([(tokens * rate) @ p, ((p * inner[:, None]).T @ p).reshape(-1)]))
    return np.array(out)


def _moments_of(table: DataFrame, multipliers: np.ndarray, most_rate: float | None) -> np.ndarray:
    """``moments`` of a durable table; a partition gives a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(multipliers), len(DOMAINS) * (1 + len(DOMAINS))))
        for batch in batches:
            tokens = batch.column("t").to_numpy(zero_copy_only=False)
            total += moments(tokens, batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), -1), multipliers, most_rate)
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["sums"])

    rows = table.where("__tokens > 0").select(F.col("__tokens").cast("double").alias("t"), F.col("__p").alias("p"))
    sums = [r.sums for r in rows.mapInArrow(run, "sums array<double>").collect()]
    return np.array(sums).reshape(-1, len(multipliers), len(DOMAINS) * (1 + len(DOMAINS))).sum(0)


def fit_rates(table: DataFrame, classifier: Classifier, weights: dict[str, float], total: float | None = None, most_rate: float | None = None) -> Plan:
    """The plan for a durable table (__tokens, __p)."""
    n = len(DOMAINS)
    parts = lambda sums: (sums[:n], sums[n:].reshape(n, n))
    have, second = parts(_moments_of(table, np.zeros((1, n)), None)[0])
    want = np.array([weights.get(d, 0.0) if present else 0.0 for d, present in zip(DOMAINS, classifier.present)])
    if classifier.model is None or have.sum() <= 0 or want.sum() <= 0:
        return Plan([], most_rate, [1 / n] * n, have.tolist(), have.tolist(), have.tolist())
    want = want / want.sum()
    targets = want * (total if total is not None else min(h / w for h, w in zip(have, want) if w > 0))
    inverse = np.linalg.pinv(second / have.sum(), rcond=1e-9) / have.sum()
    aim = second @ inverse @ targets  # the part that any rates could change
    near = NEAR * max(targets.sum(), have.sum() * NEAR)
    span, passes = second @ inverse, 0

    def sums_at(tries: np.ndarray) -> np.ndarray:
        nonlocal passes
        if (passes := passes + 1) > MOST_PASSES:
            raise ArithmeticError(f"the rates' fit hasn't converged in {MOST_PASSES} passes: slope {slope.tolist()} tokens, {near} allowed")
        return _moments_of(table, tries, most_rate)

    at = slope = np.zeros(n)
    tokens, inner = parts(sums_at(at[None])[0])
    for pull in PULLS:
        while True:
            slope = pull * second @ at + aim - span @ tokens
            if np.abs(slope).max() <= near:
                break
            step = -span.T @ np.linalg.pinv((inner + pull * second) / have.sum(), rcond=1e-15, hermitian=True) @ slope / have.sum()
            # the slope along the step grows with its length: the longest that isn't beyond the least value, in two passes
            lengths = LENGTHS
            for _ in range(2):
                tries = at + lengths[:, None] * step
                sums = sums_at(tries)
                along = [(pull * second @ m + aim - span @ parts(s)[0]) @ step for m, s in zip(tries, sums)]
                k = next((k for k in range(len(lengths)) if along[k] <= 0), len(lengths) - 1)
                if k == 0:
                    break
                lengths = np.linspace(lengths[k - 1], lengths[k], len(LENGTHS))
            at, (tokens, inner) = tries[k], parts(sums[k])
    return Plan([at.tolist()], most_rate, (have / have.sum()).tolist(), have.tolist(), targets.tolist(), tokens.tolist())


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, most_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p_good, p_poor, p_toxic, rate) for each row: the mean number of times that it is to be drawn."""
    classifier = train(docs, labels)
    table = written(with_posteriors(docs, classifier, [id_col], text_col))
    plan = fit_rates(table, classifier, weights, total, most_rate)
    return table.select(F.col("__k0").alias("doc_id"), F.col("__tokens").alias("tokens"), *(F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), plan.rate().alias("rate"))


def draw(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, most_rate: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as their rates say: the whole part of the rate as copies, and one more with the probability of the rest.

    Whether one more is drawn depends on a hash of the doc_id and text alone. All columns are kept.
    """
    classifier = train(docs, labels)
    at = {c: f"__k{i}" for i, c in enumerate(docs.columns)}
    # scored once: the fit's passes read only tokens and posteriors of what is written here
    table = written(with_posteriors(docs, classifier, docs.columns, text_col))
    rows = table.withColumn("__rate", fit_rates(table, classifier, weights, total, most_rate).rate())
    chance = F.pmod(F.xxhash64(F.lit("mixing"), at[id_col], at[text_col]), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor("__rate") + F.when(chance < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("__copies", copies).where("__copies > 0")
    if most_rate is None or most_rate > 1:
        rows = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return rows.select(*(F.col(a).alias(c) for c, a in at.items()))
