"""A quality classifier from positive and unlabelled texts.

Only texts known to be good are trusted. All other texts are unlabelled: most of them are good too, some are not, and nobody has said which.
With the share p of good texts among the unlabelled (the class prior) the risk on the bad ones needs no bad example:

    risk(g) = p E+[loss(g)] + max(0, E[loss(-g)] - p E+[loss(-g)]),    loss(z) = log(1 + exp(-z))

E+ is the mean over the trusted texts, E that over all. The second part is the risk on bad texts; it can't be negative, and
the maximum keeps a flexible g from pretending it is. g is linear in the standardised features of a text, so as long as the maximum
is not at work the risk is convex and Newton steps fit. Where it is at work, the step goes back along the gradient of the bad texts' risk.

The prior is estimated: texts are scored by a first fit, and the share of all texts above a threshold divided by the share of trusted
ones above it bounds the prior from above; the best bin is the threshold where that ratio, with its sampling error added, is smallest.

Every sum goes over all rows, in the tasks; the driver sees fixed numbers of cells per round: 2 * `d` + 2 for the
moments, d * d + d + 3 for a step, 2 * `CELLS` for the prior. The sums are decimal, so reruns agree to the last digit.

Defined results: a null text counts as empty, and an empty one has a score as any other. Rows are scored one by one, repeated rows alike. A row without an id is unlabelled
and not held out. An id with several labels is trusted if all of them are 1; other labels than 1 are never looked at. Without a trusted text every
score is 0.5; an empty table gives an empty result. Of the columns only id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coratia.llm.quality import measure
from coratia.plans.lineage import Stored, store

HELD_OUT = 1  # the remainder of the crc32 of an id, modulo 3
STEPS = 14
FIRST_PRIOR = 0.5
RIDGE = 1e-3
FURTHEST = 6.0  # standard deviations
LONGEST_STEP = 4.0
CELLS = 2_000
_SURE = 0.1  # the chance that a bin's ratio is off by more than the error added


# --- features ------------------------------------------------------------------------


def described(data: bytes) -> list[float]:
    """What the classifier sees of a UTF-8 text: shares, on two scales each, and lengths."""
    n, chars, symbols, dup_lines, repeated, lines, upper, distinct, ends, bare, marks, stutters = measure(data)
    words, wide = max(n, 1), max(chars, 1)
    shares = [
        symbols / wide, ends / words, bare / words, repeated / words, dup_lines / max(lines, 1), stutters / words,
        upper / wide, marks / words, (words - distinct) / words,
    ]
    out = []
    for x in shares:
        out += [min(x, 1.0), sqrt(min(x, 1.0)), min(x, 0.1)]
    mean = chars / words
    out += [log(1 + n), float(n < 50), max(0.0, 4 - mean), max(0.0, mean - 8), min(n / max(lines, 1), 200.0) / 200]
    # Variety falls with length for good reason: what is missing against a text of that length.
    out.append(max(0.0, 1 - distinct / (3 * sqrt(words) if words > 9 else words)))
    return out


FEATURES = len(described(b""))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _described(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([described(x) for x in series])


def features(text: str | Column) -> Column:
    return _described(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)


def _trusted(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)


def _summed(rows: DataFrame, cells: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums over all rows (x, trusted) of what `add` makes of a batch; each task sends its sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += add(_matrix(batch), _trusted(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "value"])

    exact = F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("value")
    out = np.zeros(cells)
    for row in rows.select("x", "trusted").mapInArrow(run, "cell long, value double").groupBy("cell").agg(exact).collect():
        out[row["cell"]] = row["value"]
    return out


# --- the model -----------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """g(x) = bias + weights . clipped((x - centre) / spread); prior: the estimated share of good texts."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the bias first
    prior: float

    def seen(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -FURTHEST, FURTHEST)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.seen(x) * self.weights).sum(axis=1), -500, 500)))


@dataclass(frozen=True)
class Sums:
    """Means at given weights: loss(-g) over all and over trusted texts, loss(g) over trusted ones, first and second derivatives."""

    bad_all: float
    bad_trusted: float
    good_trusted: float
    slope_all: np.ndarray
    slope_trusted: np.ndarray
    bend_all: np.ndarray
    bend_trusted: np.ndarray
    trusted: np.ndarray  # the mean of the features


def _at(model: Model, sums: Callable[[int, Callable], np.ndarray], n: float, trusted: float) -> Sums:
    d = FEATURES + 1
    square = d * d

    def add(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        z = model.seen(x)
        g = np.clip(z @ model.weights, -500, 500)
        s = 1 / (1 + np.exp(-g))
        bad, good = np.logaddexp(0, g), np.logaddexp(0, -g)
        bent = z * (s * (1 - s))[:, None]
        parts = [[bad.sum(), bad[mark].sum(), good[mark].sum()], s @ z, s[mark] @ z[mark], z[mark].sum(axis=0)]
        return np.concatenate([*parts, (z.T @ bent).ravel(), (z[mark].T @ bent[mark]).ravel()])

    found = sums(3 + 3 * d + 2 * square, add)
    at = [3, 3 + d, 3 + 2 * d, 3 + 3 * d, 3 + 3 * d + square]
    return Sums(
        found[0] / n, found[1] / trusted, found[2] / trusted, found[at[0] : at[1]] / n, found[at[1] : at[2]] / trusted,
        found[at[3] : at[4]].reshape(d, d) / n, found[at[4] :].reshape(d, d) / trusted, found[at[2] : at[3]] / trusted,
    )


def risk(s: Sums, prior: float, weights: np.ndarray) -> float:
    return prior * s.good_trusted + max(0.0, s.bad_all - prior * s.bad_trusted) + RIDGE / 2 * float(weights[1:] @ weights[1:])


def step(s: Sums, prior: float, weights: np.ndarray) -> np.ndarray:
    """Where to go from `weights`."""
    ridge = np.full(len(weights), RIDGE)
    ridge[0] = 1e-9
    if s.bad_all - prior * s.bad_trusted >= 0:
        # loss(g) - loss(-g) = -g: the trusted texts only pull towards their mean, and the risk is convex.
        slope = s.slope_all - prior * s.trusted + ridge * weights
        way = -np.linalg.solve(s.bend_all + np.diag(ridge), slope)
    else:
        # The bad texts' risk has gone below zero: back along its gradient.
        slope = s.slope_all - prior * s.slope_trusted
        way = slope / max(1e-12, float(np.linalg.norm(slope))) * 0.1
    length = float(np.linalg.norm(way))
    return way * min(1.0, LONGEST_STEP / max(length, 1e-12))


def descend(model: Model, sums: Callable[[int, Callable], np.ndarray], n: float, trusted: float, steps: int = STEPS) -> Model:
    """The model with the least risk met on the way; steps that lead up are halved."""
    best, least, way = model, np.inf, np.zeros(FEATURES + 1)
    weights = model.weights
    for _ in range(steps):
        trial = Model(model.centre, model.spread, weights, model.prior)
        s = _at(trial, sums, n, trusted)
        now = risk(s, model.prior, weights)
        if now < least:
            settled = least - now < 1e-7
            best, least, way = trial, now, step(s, model.prior, weights)
            if settled:
                break
        else:
            way = way / 4
        if float(np.linalg.norm(way)) < 1e-4:
            break
        weights = best.weights + way
    return best


def best_bin(trusted: np.ndarray, every: np.ndarray) -> float:
    """The class prior from counts of scores per cell, from the lowest score to the highest."""
    n_trusted, n = trusted.sum(), every.sum()
    above_trusted, above = np.cumsum(trusted[::-1]) / n_trusted, np.cumsum(every[::-1]) / n
    error = sqrt(log(4 / _SURE) / 2 / n) + sqrt(log(4 / _SURE) / 2 / n_trusted)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(above_trusted > 0, (above + 1.01 * error) / above_trusted, np.inf)
        at = int(np.argmin(bound))
    return float(np.clip(above[at] / above_trusted[at], 0.01, 0.99))


def fit(sums: Callable[[int, Callable], np.ndarray], steps: int = STEPS) -> Model | None:
    """The model, from a function that sums over all rows to learn from; None without a trusted text."""

    def moments(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), mark.sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    found = sums(2 + 2 * FEATURES, moments)
    n, trusted = found[0], found[1]
    if not trusted:
        return None
    centre = found[2 : 2 + FEATURES] / n
    spread = np.sqrt(np.clip(found[2 + FEATURES :] / n - centre * centre, 0, None))
    spread = np.where(spread < 1e-6, 1.0, spread)
    model = descend(Model(centre, spread, np.zeros(FEATURES + 1), FIRST_PRIOR), sums, n, trusted, steps // 2)

    def cells(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        at = np.minimum((model.scores(x) * CELLS).astype(np.int64), CELLS - 1)
        return np.concatenate([np.bincount(at[mark], minlength=CELLS), np.bincount(at, minlength=CELLS)]).astype(np.float64)

    counts = sums(2 * CELLS, cells)
    prior = best_bin(counts[:CELLS], counts[CELLS:])
    return descend(Model(centre, spread, model.weights, prior), sums, n, trusted, steps)


# --- the table -----------------------------------------------------------------------


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == HELD_OUT, F.lit(False))


def described_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Stored:
    """(id, held_out, trusted, x), one row per row of `docs`. Labels of rows held out are not looked at."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).alias("label"))
    known = known.filter("id is not null and label is not null").filter(~held_out("id"))
    good = known.groupBy("id").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least = 1 and most = 1")
    good = store(good.select("id", F.lit(True).alias("trusted")), "trusted")
    rows = docs.select(F.col(id_column).alias("id"), features(text).alias("x"))
    # The texts are read once; only ids and features are joined.
    narrow = store(rows, "features").df.withColumn("held_out", held_out("id")) if not good.small else rows.withColumn("held_out", held_out("id"))
    joined = narrow.join(good.sized(), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return store(joined, "described")


def learn(rows: DataFrame, steps: int = STEPS) -> Model | None:
    """The model from the rows (x, trusted, held_out) that are not held out."""
    seen = rows.filter("not held_out")
    return fit(lambda cells, add: _summed(seen, cells, add), steps)


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted), one row per row of `docs`."""
    rows = described_rows(docs, labels, id_column, text, label).df
    model = learn(rows)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5) if model is None else model.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores)], ["id", "held_out", "score"])

    out = rows.select("id", "held_out", "x").mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
