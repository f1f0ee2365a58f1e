"""Mixing to target weights by soft membership: calibrated posteriors, rates by projected gradient.

The rates minimise half the squared distance of the domains' expected token shares from their targets,
each divided by its target, plus a ridge towards 1, over rates from 0 to a highest one. Where the
posteriors hardly tell domains apart the ridge wins: rates stay near 1 and the miss is reported. Every step is one pass over (tokens, p): it exchanges a gradient of one
number a domain.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import MAX_FEATURES, MAX_LABELLED, chance, collect_training, fit, labelled, matrix, presence, select_features, sparse_chance, word_counts
from .scratch import Scratch, fresh
from .textkit import U, mix as scramble, slices

#: Share of the expected tokens that each domain is to get.
TARGETS = {"good": 0.90, "plain": 0.05, "toxic": 0.03, "toxic_plain": 0.02}
#: Difference of a domain's share from its target that is reported.
MISS = 2e-3
#: Highest rate: times that a document may be drawn.
MOST = 20.0
#: Parts of the labelled sample: each is judged by models of the others when posteriors are calibrated.
FOLDS = 4


def domains() -> dict[str, Column]:
    """Domains as conditions on the labelled table; a labelled row meets exactly one."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return {"good": good & ~toxic, "plain": ~good & ~toxic, "toxic": good & toxic, "toxic_plain": ~good & toxic}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _odds(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What calibration sees: log-odds of the one-against-rest models, the log of the number of words, and ones."""
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.column_stack([np.log(p / (1 - p)), np.log1p(tokens) / 5, np.ones(len(p))])


def calibrate(p: np.ndarray, tokens: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a softmax regression from odds to domains, by Newton steps; at the start each domain has its own odds.

    Its constant and word weights are all but free, so that on the sample (predicted by models that
    didn't see it) the mean posterior of a domain is its share.
    """
    x, k = _odds(p, tokens), y.shape[1]
    m = x.shape[1]
    start = np.zeros((m, k))
    start[:k] = np.eye(k)
    penalty = np.full((m, k), l2)
    penalty[k:] = 1e-3
    w = start.copy()
    for _ in range(steps):
        q = _softmax(x @ w)
        gradient = x.T @ (q - y) + penalty * (w - start)
        curve = np.diag(penalty.ravel())
        for a in range(k):
            for b in range(k):
                curve[a::k, b::k] += (x.T * (q[:, a] * ((a == b) - q[:, b]))) @ x
        move = np.linalg.solve(curve, gradient.ravel()).reshape(m, k)
        w -= move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


def posteriors(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], id_col: str, text_col: str, max_labelled: int, scratch: Scratch, out_col: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """All columns of `docs` and `out_col`: tokens (words of the text) and p, the probability of each domain.

    One-against-rest models give odds; a softmax regression on the odds that models fitted on the
    other FOLDS - 1 parts of the sample give its rows makes them probabilities.
    """
    k = len(conditions)
    rows = labelled(docs, labels, conditions, id_col, text_col, max_labelled)
    chosen = select_features(rows, k, scratch, limit=max_features)
    doc, which, y, lid, words = collect_training(rows, chosen, k)
    x = matrix(doc, which, len(y), len(chosen), np.zeros((len(y), 0)))
    models = [fit(x, y[:, j]) for j in range(k)] if len(y) else []
    fold, held = scramble(lid.astype(np.int64).view(U)) % U(FOLDS), np.full((len(y), k), 1 / k)
    for f in range(FOLDS):
        own = fold == f
        if own.any() and not own.all():
            held[own] = np.stack([chance(x[own], fit(x[~own], y[~own, j])) for j in range(k)], 1)
    weights = calibrate(held, words, y) if len(y) else None
    kind = pa.struct([("tokens", pa.int64()), ("p", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                n = part.num_rows
                tokens = word_counts(part.column(text_col))
                p = np.full((n, k), 1 / k)
                if models:
                    doc, which = presence(part.column(text_col), chosen)
                    p = _softmax(_odds(np.stack([sparse_chance(doc, which, np.zeros((n, 0)), w, n) for w in models], 1), tokens) @ weights)
                column = pa.StructArray.from_arrays([pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out_col])

    both = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, both)]))


def _rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]], size: float, ridge: float, ends: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after the given steps of length `size` (that times the gradient by domain, momentum), from 1: the last two, and the point that the next step starts from."""
    before = r = at = np.ones(len(p))
    for g, momentum in steps:
        before, r = r, np.clip(at - (p @ g + size * ridge * (at - 1)), *ends)
        at = r + momentum * (r - before)
    return before, r, at


def descend(table: DataFrame, targets: np.ndarray, ridge: float, tolerance: float, max_steps: int, ends: tuple[float, float] = (0.0, MOST)) -> tuple[list[tuple[np.ndarray, float]], float, np.ndarray | None, float]:
    """The steps of accelerated projected gradient and their length (for `_rates`), the domain shares reached, and the last move of the rates.

    Minimises the sum of (m(r) / m(1) - target)^2 / (2 * target) over the domains + ridge / 2 * sum of
    tokens * (r - 1)^2 / m(1) over rates inside `ends`, where m(r) is the expected number of tokens by
    domain (of all, for m(1)). The division by targets lets small domains count as large ones do; the
    domains' second moments (sum of tokens * p * p' / m(1)) give the step length of the steepest direction.
    Each step is a pass over `table` (tokens, p) that replays the steps so far and returns the shares
    at the next point, those reached, and two sums; momentum starts anew where it points uphill. It ends when the
    rates' root mean square move (by tokens) is at most `tolerance`. No step and no shares for a table without tokens.
    """
    k = len(targets)

    def sums(steps: list[tuple[np.ndarray, float]], moments: bool = False) -> np.ndarray:
        width = 3 + 2 * k + (k * k if moments else 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column("p").flatten().to_numpy().reshape(-1, k)
                    t = batch.column("tokens").to_numpy().astype(np.float64)
                    before, r, at = _rates(p, steps, size, ridge, ends)
                    start = _rates(p, steps[:-1], size, ridge, ends)[2]
                    out[:3] += t.sum(), t @ (r - start) ** 2, t @ ((start - r) * (r - before))
                    out[3 : 3 + k] += (t * at) @ p
                    out[3 + k : 3 + 2 * k] += (t * r) @ p
                    if moments:
                        out[3 + 2 * k :] += ((p.T * t) @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(out)], names=["j", "v"])

        total = np.zeros(width)
        for row in table.mapInArrow(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect():
            total[row.j] = row.v
        return total

    size = 0.0
    got = sums([], True)
    tokens, share = got[0], got[3 : 3 + k]
    if not tokens:
        return [], size, None, 0.0
    each = 1 / np.sqrt(np.maximum(targets, 1e-3))
    size = 1 / (float(np.linalg.eigvalsh(each[:, None] * got[3 + 2 * k :].reshape(k, k) / tokens * each)[-1]) + ridge)
    steps, theta, reached, moved = [], 1.0, share / tokens, 0.0
    for _ in range(max_steps):
        following = (1 + np.sqrt(1 + 4 * theta**2)) / 2
        steps.append((size * each**2 * (share / tokens - targets), (theta - 1) / following))
        theta = following
        got = sums(steps)
        if got[2] > 0:  # uphill: the last step stays, its momentum goes
            steps[-1], theta = (steps[-1][0], 0.0), 1.0
            got = sums(steps)
        share, reached, moved = got[3 : 3 + k], got[3 + k : 3 + 2 * k] / tokens, float(np.sqrt(got[1] / tokens))
        if moved <= tolerance:
            break
    return steps, size, reached, moved


def mix(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", conditions: dict[str, Column] | None = None, targets: dict[str, float] | None = None,
    ridge: float = 1e-3, tolerance: float = 5e-5, max_steps: int = 100, max_labelled: int = MAX_LABELLED, out_col: str = "_rate", max_features: int = MAX_FEATURES, least: float = 0.0, most: float = MOST, strict: bool = False,
) -> DataFrame:
    """A rate from `least` (0 or more) to `most` for every document, so that the expected tokens of the domains meet the targets.

    A classifier fitted on at most `max_labelled` labelled rows, with at most `max_features` words a domain, gives every text its domain
    posteriors; a text of t words and rate r counts r * t * p tokens to a domain. Rates are the
    least-squares solution that `descend` describes, kept near 1 by `ridge`; equal posteriors get
    equal rates. Where a domain's share stays more than MISS off its target (no rates reach it, or
    the steps ran out) a warning gives the shares reached, with `strict` an error. Very long texts are taken whole; ties don't arise. A null or empty text has no words, the posteriors of a text without features,
    and a rate by them. Without labels all posteriors are equal. Repeated rows count as often as
    they stand. An empty table gives no rows.

    :return: all columns and rows of `docs` (none is renamed) and the struct column `out_col`, whose name must be new:
        tokens, p (an array in the order of `targets`), rate, miss (largest distance of a domain's share from its target, the same for all rows).

    Two narrow passes over the texts; the steps read a written table of a few numbers a row.
    """
    conditions, targets = conditions or domains(), targets or TARGETS
    if list(conditions) != list(targets):
        raise ValueError("domains and targets must have the same names in the same order")
    if fresh(docs, out_col) != out_col:
        raise ValueError(f"documents have a column {out_col} already")
    scratch, mixed = Scratch(docs.sparkSession, "mixing"), fresh(docs, "_mix")
    aim = np.array(list(targets.values()), float)
    with_p = posteriors(docs, labels, conditions, id_col, text_col, max_labelled, scratch, mixed, max_features)
    table = scratch.keep(with_p.select(f"{mixed}.tokens", f"{mixed}.p"))
    aim = aim / aim.sum()
    steps, size, share, left = descend(table, aim, ridge, tolerance, max_steps, (least, most))
    miss = float(np.abs(share - aim).max()) if share is not None else 0.0
    if miss > MISS:
        told = f"mixing targets are missed by {miss:.4f} (last move {left:.1e}): " + ", ".join(f"{c} {x:.4f} for {y:.4f}" for c, x, y in zip(targets, share, aim, strict=True))
        if strict:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    fields = [("tokens", pa.int64(), T.LongType()), ("p", pa.list_(pa.float64()), T.ArrayType(T.DoubleType())), ("rate", pa.float64(), T.DoubleType()), ("miss", pa.float64(), T.DoubleType())]
    kind = pa.struct([(c, a) for c, a, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(mixed)
            p = x.field("p")
            rate = _rates(p.flatten().to_numpy().reshape(batch.num_rows, -1), steps, size, ridge, (least, most))[1] if batch.num_rows else np.zeros(0)
            out = pa.StructArray.from_arrays([x.field("tokens"), p, pa.array(rate), pa.array(np.full(batch.num_rows, miss))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], out_col])

    rate = T.StructType([T.StructField(c, t) for c, _, t in fields])
    return with_p.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, rate)]))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, **options) -> DataFrame:
    """One row per row of `docs`: id, n_words, the posterior of each domain, rate."""
    names = list(targets or TARGETS)
    out = mix(docs.select(id_col, text_col), labels, id_col, text_col, targets=targets, **options)
    return out.select(id_col, F.col("_rate.tokens").alias("n_words"), *(F.round(F.col("_rate.p")[k], 6).alias(f"p_{c}") for k, c in enumerate(names)), F.round("_rate.rate", 6).alias("rate"))
