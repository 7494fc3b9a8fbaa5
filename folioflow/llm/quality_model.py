"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows with label 1; the unlabelled rows are all documents. The share of good text
among them is estimated first, then a linear model minimises

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]),    l(z) = log(1 + exp(-z)).

For the logistic loss the unbiased part is convex, so Newton's method needs few passes; a step that makes the
bracket negative is halved until it isn't. Every pass sums gradient and Hessian over all rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import let, shingle_hashes, words, written
from folioflow.llm.quality_rules import STOP_WORDS

PASSES = 30  # at most; eight or so are needed
RIDGE = 1e-3
BINS = 200
LEAST_TAIL = 0.1  # smallest share of the positives from which the prior is read
KEEP_FROM = 0.7


def features(text: Column) -> Column:
    """array<double> of shares and logarithms taken from the text alone; zeros for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    stop = [form for w in dict.fromkeys(STOP_WORDS) for form in (w, w.capitalize(), w.upper())]
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")

    def of(w: Column) -> Column:
        def made(c: Column) -> Column:
            share = lambda part, whole: F.when(c[whole] > 0, c[part] / c[whole]).otherwise(F.lit(0.0))
            return F.array(
                F.log1p(c["n"]),
                share("chars", "n"),
                share("distinct", "n"),
                share("distinct3", "n3"),
                share("stops", "n"),
                share("symbols", "n"),
                share("exclaims", "n"),
                share("capitals", "chars"),
                share("digits", "chars"),
                share("stops_marks", "n"),
                F.log1p(share("n", "lines")),
                share("distinct_lines", "lines"),
                share("twice", "n"),
            )

        lines = F.split(text, "\n", -1)
        twice = F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))
        number = lambda c, name: c.cast("double").alias(name)
        return let(
            F.struct(
                number(F.size(w), "n"),
                number(F.length(F.array_join(w, "")), "chars"),
                number(F.size(F.array_distinct(w)), "distinct"),
                number(F.size(F.array_distinct(shingle_hashes(w, 3))), "distinct3"),
                number(F.greatest(F.size(w) - 2, F.lit(0)), "n3"),
                number(F.size(F.filter(w, lambda x: x.isin(stop))), "stops"),
                count(r"[#*$%&|<>{}~^=+]").alias("symbols"),
                count(r"[!?]").alias("exclaims"),
                count(r"\p{Lu}").alias("capitals"),
                count(r"[0-9]").alias("digits"),
                count(r"[.,;:]").alias("stops_marks"),
                number(F.size(lines), "lines"),
                number(F.size(F.array_distinct(lines)), "distinct_lines"),
                number(F.size(twice), "twice"),
            ),
            made,
        )

    return let(words(text), of)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from. A null id is never labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Score = 1 / (1 + exp(-z)) with z linear in standardised, clipped values and their squares."""

    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float
    converged: bool = True

    def score(self, values: Column) -> Column:
        size = len(self.mean)
        z = F.lit(float(self.weights[-1]))
        for i in range(size):
            x = F.greatest(F.least((F.get(values, F.lit(i)) - self.mean[i]) / self.deviation[i], F.lit(5.0)), F.lit(-5.0))
            z = z + x * float(self.weights[i]) + x * x * float(self.weights[size + i])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _design(values: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    x = np.clip((values - mean) / deviation, -5, 5)
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def _total(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of ``part(values, positive)``, an array of ``size`` numbers per batch."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for frame in frames:
            if len(frame):
                total += part(np.stack(frame["x"].to_numpy()), frame["positive"].to_numpy())
        yield pd.DataFrame({"at": np.arange(size), "v": total})

    summed = rows.select("x", "positive").mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in summed.collect():
        out[r["at"]] = r["v"]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _minimise(rows: DataFrame, mean, deviation, prior: float, n_u: int, n_p: int, xp: np.ndarray) -> tuple[np.ndarray, bool]:
    """The last weights whose bracket was seen not to be negative, and whether steps had become small there."""
    d = len(xp)
    w, step, before = np.zeros(d), None, None
    for _ in range(PASSES):
        now = w

        def part(values, positive, now=now):
            x = _design(values, mean, deviation)
            z = x @ now
            p = _sigmoid(z)
            hessian = (x * (p * (1 - p))[:, None]).T @ x
            risks = [_softplus(z).sum(), _softplus(z[positive]).sum()]
            return np.concatenate([x.T @ p, hessian.ravel(), risks])

        total = _total(rows, part, d + d * d + 2)
        bracket = total[-2] / n_u - prior * total[-1] / n_p
        if bracket < 0 and before is not None:
            step = step / 2
            if np.abs(step).max() < 1e-4:
                return before, True
            w = before + step
            continue
        gradient = total[:d] / n_u - prior * xp + RIDGE * w
        hessian = total[d:-2].reshape(d, d) / n_u + RIDGE * np.eye(d)
        before, step = w, -np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            return before, True
        w = before + step
    return before, False


def fit(rows: DataFrame) -> Model | None:
    """A model from rows (x array<double>, positive boolean); None without a positive row.

    ``positive`` marks trusted rows, all rows are the unlabelled ones. What reaches the driver
    are sums whose size depends on the number of features only.
    """
    rows = rows.filter("x is not null")
    probe = rows.limit(1).collect()
    if not probe:
        return None
    size = len(probe[0]["x"])

    def moments(values, positive):
        return np.concatenate([values.sum(0), (values * values).sum(0), [len(values), positive.sum()]])

    m = _total(rows, moments, 2 * size + 2)
    n_u, n_p = int(m[-2]), int(m[-1])
    if not n_p:
        return None
    mean = m[:size] / n_u
    deviation = np.sqrt(np.maximum(m[size : 2 * size] / n_u - mean**2, 1e-12))
    deviation = np.where(deviation < 1e-6, 1.0, deviation)
    d = 2 * size + 1
    xp = _total(rows, lambda v, p: _design(v[p], mean, deviation).sum(0), d) / n_p

    # A first model tells positives from unlabelled rows; where it is surest the unlabelled are positive too,
    # so the ratio of the two tails there is the prior.
    first, _ = _minimise(rows, mean, deviation, 0.5, n_u, n_p, xp)

    def histogram(values, positive):
        s = np.minimum((_sigmoid(_design(values, mean, deviation) @ first) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(s, minlength=BINS), np.bincount(s[positive], minlength=BINS)])

    h = _total(rows, histogram, 2 * BINS)
    tail_u, tail_p = (np.cumsum(part[::-1]) / part.sum() for part in (h[:BINS], h[BINS:]))
    ratios = [u / p for u, p in zip(tail_u, tail_p, strict=True) if p >= LEAST_TAIL]
    prior = float(np.clip(min(ratios), 0.05, 0.95))
    weights, converged = _minimise(rows, mean, deviation, prior, n_u, n_p, xp)
    if not converged:
        warnings.warn(f"the quality model has not converged in {PASSES} passes", stacklevel=2)
    return Model(tuple(mean.tolist()), tuple(deviation.tolist()), tuple(weights.tolist()), prior, converged)


def prepare(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, x, positive) of every document, written once: texts are read a single time."""
    trusted = (
        labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("_id")).distinct().withColumn("_p", F.lit(True))
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        features(F.col("text")).alias("x"),
    )
    # A left join with few and distinct rows: a hot id on the left is split by AQE.
    return written(
        rows.join(trusted, F.col("doc_id") == F.col("_id"), "left").select(
            "doc_id", "held_out", "x", F.coalesce("_p", F.lit(False)).alias("positive")
        ),
        "quality-features",
    )


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Only the text enters a score. Null and empty texts are scored from zero features, texts of any length whole; repeated
    rows get the same score; labels that contradict one another count as positive if one is; without trusted
    rows every score is 0.5; an empty table gives no rows. Other columns are not read.
    """
    rows = prepare(docs, labels)
    model = fit(rows)
    score = model.score(F.col("x")) if model else F.lit(0.5)
    scored = rows.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
