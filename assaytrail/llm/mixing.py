"""Mixing to target weights with soft membership.

Domains come from the label table: ``toxic`` (toxic is 1), ``poor`` (quality is 0) and ``good`` (neither). Two classifiers fitted on
about ``TRAIN_ROWS`` labelled rows (a bound: at most half as many more) give every document a posterior over the domains: the subword model of
:mod:`assaytrail.llm.toxicity`, and a logistic regression on a dozen measures of form.

A document's rate says how often it is wanted. With tokens t and posteriors p, the expected total of a domain is the sum of
t * rate * p. Rates of at least 0 whose totals match the targets, and which stay near 1, are found by projected gradient descent on the
squared distance of the totals, measured in units of their own spread (the matrix G, sum of t p p' over rows that are not clipped): in
these units one step suffices if it clips no further rows. A step that does not come closer is replaced by one in units of all rows, which
is never too long. A step changes each rate by the posterior times one number per
domain, so a rate follows from the list of those numbers. An iteration is one aggregation of a few sums over stored posteriors, and
nothing per document is kept or sent to the driver.

The total of all targets is such that the first domain with a target above 0 keeps its expected tokens, if no number is given.

``copies`` rounds the rate down or up by a hash of doc_id, so that its mean is the rate.

Cases: a null, empty or blank text has no tokens and a posterior from no words; repeated rows get equal rates and copies; labels that
are null or belong to no document are left out; without labels every document is good; a target for a domain in which no document
has tokens cannot be met and is left as it is; a target of 0 is met as nearly as posteriors above 0 and
``ITERATIONS`` steps allow; targets that are negative,
all 0 or of other domains are refused; an empty table gives an empty result; other columns are ignored by :func:`mix` and
passed on by :func:`mixed_documents`, whatever their names (but those that begin with an underscore).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaytrail.llm import divergence, toxicity
from assaytrail.llm.common import slices, stored

DOMAINS = ["good", "poor", "toxic"]
#: Shares of all expected tokens.
TARGETS = {"good": 0.96, "poor": 0.02, "toxic": 0.02}
TRAIN_ROWS = 4000
ITERATIONS = 40
#: Largest distance from a target, as a share of all targets, at which the descent ends.
CLOSE = 1e-7


# Posteriors

def form_measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(measures of form, number of words) of each text."""
    words, classes = divergence._Words(texts), divergence.class_counts(texts)
    n, chars = words.counts, np.maximum(classes.sum(1), 1)
    common = divergence.bucket_counts(words)[:, :-1].sum(1)
    shares = [classes[:, k] / chars for k, name in enumerate(divergence.CLASSES) if name != "lower"]
    return np.stack([*shares, common / np.maximum(n, 1), divergence.repeat_words(words) / np.maximum(n, 1), np.log1p(n),
                     np.minimum(chars / np.maximum(n, 1), 50.0)], 1), n


class Logistic:
    """Logistic regression on standardised measures and their squares, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        z, self.weight = self._terms(x), None
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            pull = ridge * w
            pull[0] = 0
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + ridge * np.eye(len(w)), z.T @ (p - y) + pull)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weight = w

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, z ** 2], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._terms(x) @ self.weight, -30, 30)))


def in_parts(measure, texts: pa.Array, rows: int = 200) -> np.ndarray:
    """The measures of many texts, a part of them at a time: bounds the driver's memory."""
    return np.concatenate([measure(texts[i:i + rows]) for i in range(0, len(texts), rows)])


class Posteriors:
    """Domain posteriors of texts, in the order of DOMAINS.

    The subword model learns from a part of the rows; a logistic regression over its mean and largest word values learns from the
    others how much they are worth, so that posteriors are right on rows the subword model has not seen.
    """

    def __init__(self, texts: pa.Array, quality: np.ndarray, toxic: np.ndarray, learn: float = 0.7):
        cut = int(len(toxic) * learn)
        self.words = toxicity.train(texts[:cut], toxic[:cut], balance=0.4)
        rest, clean = toxic[cut:], toxic == 0
        self.toxic = Logistic(in_parts(self.words.measures, texts[cut:]), rest, 0.1) if len(np.unique(rest)) == 2 else None
        both = len(np.unique(quality[clean])) == 2
        self.good = Logistic(in_parts(lambda t: form_measures(t)[0], texts.filter(pa.array(clean))), quality[clean]) if both else None

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        measures, tokens = form_measures(texts)
        toxic = self.toxic(self.words.measures(texts)) if self.toxic else np.zeros(len(texts))
        good = self.good(measures) if self.good else np.ones(len(texts))
        return np.stack([(1 - toxic) * good, (1 - toxic) * (1 - good), toxic], 1), tokens


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Posteriors:
    sample = toxicity.training_rows(docs, labels, ["quality", "toxic"], rows).toArrow().combine_chunks()
    if not sample.num_rows:
        return Posteriors(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Posteriors(sample.column("_text").combine_chunks(), sample.column("_quality").to_numpy().astype(np.int64),
                      sample.column("_toxic").to_numpy().astype(np.int64))


def with_posteriors(docs: DataFrame, model: Posteriors, names: list[str]) -> DataFrame:
    """The columns ``names``, _tokens and _p_<domain>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)                  # about half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, tokens = shared.value(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(tokens), *map(pa.array, p.T.copy())],
                                             [*names, "_tokens", *(f"_p_{d}" for d in DOMAINS)])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("_tokens", T.LongType()),
                           *(T.StructField(f"_p_{d}", T.DoubleType()) for d in DOMAINS)])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


# Rates

def rate(steps: list[list[float]]) -> Column:
    """The rate of a row after the steps of the descent: each takes away posterior times step, and clips at 0."""
    start = F.lit(1.0)
    if not steps:
        return start
    moved = lambda now, step: F.greatest(F.lit(0.0), now - sum(F.col(f"_p_{d}") * step[k] for k, d in enumerate(DOMAINS)))
    return F.aggregate(F.array(*[F.array(*map(F.lit, s)) for s in steps]), start, moved)


def descend(rows: DataFrame, targets: dict[str, float], tokens: float | None = None) -> list[list[float]]:
    """The steps after which the expected totals of ``rows`` (_tokens, _p_...) match ``targets`` (shares) of ``tokens``."""
    size = len(DOMAINS)
    p, t, r = [F.col(f"_p_{d}") for d in DOMAINS], F.col("_tokens").cast("double"), F.col("_r")

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """(expected totals, G over the rows that are not clipped)."""
        active = F.when(r > 0, t).otherwise(0.0)
        found = rows.withColumn("_r", rate(steps)).agg(
            *[F.sum(active * p[i] * p[j]) for i in range(size) for j in range(size)], *[F.sum(t * r * x) for x in p]).first()
        values = np.array([x or 0.0 for x in found], float)
        return values[size * size:], np.linalg.pinv(values[:size * size].reshape(size, size), rcond=1e-12, hermitian=True)

    if set(targets) != set(DOMAINS) or min(targets.values()) < 0 or not sum(targets.values()) > 0:
        raise ValueError(f"targets must be shares of {DOMAINS}, none below 0 and one above it")
    now, units = totals([])
    all_units = units
    share = np.array([targets[d] for d in DOMAINS], float) / sum(targets.values())
    first = int(np.flatnonzero(share)[0])
    wanted = share * (tokens if tokens is not None else now[first] / share[first])
    steps: list[list[float]] = []
    while len(steps) < ITERATIONS and np.abs(now - wanted).max() > CLOSE * wanted.sum():
        after, new_units = totals([*steps, (units @ (now - wanted)).tolist()])
        if np.abs(after - wanted).max() < np.abs(now - wanted).max():
            steps.append((units @ (now - wanted)).tolist())
        else:                                                                 # too long a step: that over all rows never is
            steps.append((all_units @ (now - wanted)).tolist())
            after, new_units = totals(steps)
        now, units = after, new_units
    return steps


def _copies(rate: Column) -> Column:
    """The rate rounded by a hash of doc_id."""
    return F.floor(rate + F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 53)) / float(1 << 53)).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None) -> DataFrame:
    """doc_id, n_tokens, the posteriors, rate and copies of every document."""
    rows = stored(with_posteriors(docs, fit(docs, labels), ["doc_id"]), "posteriors")
    wanted = rate(descend(rows, targets or TARGETS, tokens))
    return (rows.withColumn("_rate", wanted)
            .select("doc_id", F.col("_tokens").alias("n_tokens"), *[F.col(f"_p_{d}").alias(f"p_{d}") for d in DOMAINS],
                    F.col("_rate").alias("rate"), _copies(F.col("_rate")).alias("copies")))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None,
                    grow: bool = True) -> DataFrame:
    """``docs`` with each row as often as its copies say. Without ``grow``, all rates are lowered by one factor where they add up to
    more than the number of rows: shares of the domains stay, and about as many rows come out as go in, at most.

    Rows are stored with their posteriors, so each text is scored once."""
    rows = stored(with_posteriors(docs, fit(docs, labels), docs.columns), "posteriors")
    steps, factor = descend(rows, targets or TARGETS, tokens), 1.0
    if not grow:
        n, total = rows.select(rate(steps).alias("_rate")).agg(F.count(F.lit(1)), F.sum("_rate")).first()
        factor = min(1.0, n / total) if total else 1.0
    out = rows.withColumn("_rate", rate(steps) * factor).withColumn("_copies", _copies(F.col("_rate")).cast("int"))
    return out.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
