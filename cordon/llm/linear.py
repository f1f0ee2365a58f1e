"""Sparse linear text models: features in doubt-free association with labels, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import BLANK_SPLIT, LETTER_DIGIT, LOWER, SpanHash, U, flatten, mix, slices, split_ranges, word_spans

#: Labelled rows that a model is fitted on at most, taken in the order of a hash of their id.
MAX_LABELLED = 10_000
#: Features that are kept for each target.
MAX_FEATURES = 128
_PREFIXES = (4, 5, 6, 7)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of each text, and for each text its range."""
    data, offsets = flatten(texts)
    data = LOWER[data]
    start, end, at = word_spans(data, offsets, LETTER_DIGIT)
    spans = SpanHash(data)
    kinds = [spans(start, end)]
    for n in _PREFIXES:
        kinds.append(mix(spans(start, np.minimum(start + n, end)) + U(n)))
    return np.stack(kinds, 1).ravel(), at * len(kinds)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text, as runs of non-blank characters."""
    data, offsets = flatten(texts)
    return np.diff(word_spans(data, offsets, BLANK_SPLIT)[2]).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], id_col: str, text_col: str, limit: int) -> DataFrame:
    """Texts of at most `limit` labelled ids, with one boolean column y<k> for each target; ids without a full label are left out."""
    ys = [c.alias(f"y{k}") for k, c in enumerate(targets.values())]
    picked = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("lid"), *ys).dropna().dropDuplicates(["lid"]).orderBy(F.xxhash64("lid"), "lid").limit(limit)
    own = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return own.join(F.broadcast(picked), "lid")


def select_features(rows: DataFrame, n_targets: int, scratch: Scratch, min_docs: int = 5, min_z: float = 4.0, limit: int = MAX_FEATURES) -> np.ndarray:
    """Sorted hashes of the features whose presence differs most between the classes of some target (z of two shares)."""
    names = [f"y{k}" for k in range(n_targets)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = features(part.column("text"))
                own = [np.unique(x) for x in split_ranges(hashes, at)]
                y = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], 1)
                feature, where = np.unique(np.concatenate(own), return_inverse=True)
                doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
                sums = [np.bincount(where, minlength=len(feature))] + [np.bincount(where, weights=y[doc, k], minlength=len(feature)) for k in range(n_targets)]
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in sums)], names=["feature", "n", *names])

    total = rows.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in names)).first()
    if not total.n:
        return np.zeros(0, U)
    counts = scratch.keep(rows.mapInArrow(count, "feature long, n long, " + ", ".join(f"{c} long" for c in names)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ["n", *names])).where(F.col("n") >= min_docs))
    best = set()
    for c in names:
        share = (total[c] or 0) / total.n
        if 0 < share < 1:
            z = F.abs(F.col(c) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
            best |= {r.feature for r in counts.withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(limit).select("feature").collect()}
    return np.sort(np.array(sorted(best), np.int64).view(U))


def presence(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, index of a chosen feature) for each chosen feature that a text has."""
    hashes, at = features(texts)
    if not len(chosen) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
    hit = np.flatnonzero(chosen[where] == hashes)
    doc = np.searchsorted(at, hit, side="right") - 1
    both = np.unique(doc * len(chosen) + where[hit])
    return both // len(chosen), both % len(chosen)


def collect_training(rows: DataFrame, chosen: np.ndarray, n_targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse presence rows of the sample, its labels, ids and numbers of words; bounded by the sample and by the number of features."""
    names = [f"y{k}" for k in range(n_targets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, which = presence(part.column("text"), chosen)
                lists = np.split(which.astype(np.int32), np.searchsorted(doc, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column("lid"), pa.array(lists, pa.list_(pa.int32())), pa.array(word_counts(part.column("text"))), *(part.column(c) for c in names)], names=["lid", "on", "words", *names])

    got = rows.mapInArrow(run, "lid long, on array<int>, words long, " + ", ".join(f"{c} boolean" for c in names)).toArrow().sort_by("lid").combine_chunks()
    on = [np.asarray(x, np.int64) for x in got.column("on").to_pylist()]
    doc = np.repeat(np.arange(len(on)), [len(x) for x in on])
    y = np.stack([got.column(c).to_numpy().astype(np.float64) for c in names], 1) if len(on) else np.zeros((0, n_targets))
    return doc, np.concatenate(on) if on else np.zeros(0, np.int64), y, got.column("lid").to_numpy(), got.column("words").to_numpy()


def matrix(doc: np.ndarray, which: np.ndarray, n: int, n_features: int, dense: np.ndarray) -> np.ndarray:
    """Presence columns, then the dense ones, then a column of ones."""
    x = np.zeros((n, n_features + dense.shape[1] + 1))
    x[doc, which] = 1
    x[:, n_features:-1] = dense
    x[:, -1] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of x, of ones, isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = chance(x, w)
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        move *= min(1.0, 4.0 / max(1e-12, np.abs(move).max()))
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def sparse_chance(doc: np.ndarray, which: np.ndarray, dense: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    m = len(w) - dense.shape[1] - 1
    z = w[-1] + dense @ w[m:-1] + np.bincount(doc, weights=w[which], minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
