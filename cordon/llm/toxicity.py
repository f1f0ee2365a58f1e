"""Toxicity by a classifier chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import MAX_FEATURES, MAX_LABELLED, chance, collect_training, fit, labelled, matrix, presence, select_features, sparse_chance
from .scratch import Scratch, fresh
from .textkit import slices

FOLDS = 5


def categories() -> dict[str, Column]:
    """The chain's categories, in order, as conditions on the labelled table."""
    return {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_junk": (F.col("toxic") == 1) & (F.col("quality") == 0)}


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))[:, None] / 4


def fit_chain(doc: np.ndarray, which: np.ndarray, y: np.ndarray, ids: np.ndarray, n_features: int) -> list[np.ndarray]:
    """One linear model a category. Model k sees the features and, for each earlier category, the
    probability that a model which had not seen the row gave it (out of fold)."""
    n, models, dense = len(y), [], np.zeros((len(y), 0))
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    for k in range(y.shape[1]):
        x, out = matrix(doc, which, n, n_features, dense), np.zeros(n)
        for f in range(FOLDS if k + 1 < y.shape[1] else 0):
            if (fold != f).any():
                out[fold == f] = chance(x[fold == f], fit(x[fold != f], y[fold != f, k]))
        models.append(fit(x, y[:, k]))
        dense = np.concatenate([dense, _logit(out)], 1)
    return models


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: dict[str, Column] | None = None, max_labelled: int = MAX_LABELLED, out_col: str = "_chain", max_features: int = MAX_FEATURES) -> DataFrame:
    """Probabilities of the chain's categories for every text.

    :param labels: id_col and the columns that the categories' conditions read. The models are
        fitted on at most `max_labelled` labelled rows, in the order of a hash of the id; the
        features are words and word beginnings whose presence differs between the classes, at most
        `max_features` of them for each category.
    :return: all columns and rows of `docs` (none is renamed) and the struct column `out_col` of
        one double a category; its name must be new.

    A null or empty text has no features and gets the share of each category among texts
    without any. Without labels, or with a single class, every probability is that of the class
    seen, or 0. Rows are judged one by one, so repeated rows get equal results; an id that repeats in
    `labels` counts once. Texts of any length are read whole. An empty table gives no rows. One narrow pass over `docs` after the fit; the models are small arrays in the task.
    """
    if fresh(docs, out_col) != out_col:
        raise ValueError(f"documents have a column {out_col} already")
    chain = chain or categories()
    names = list(chain)
    rows = labelled(docs, labels, chain, id_col, text_col, max_labelled)
    chosen = select_features(rows, len(chain), Scratch(docs.sparkSession, "toxicity"), limit=max_features)
    doc, which, y, ids, _ = collect_training(rows, chosen, len(chain))
    models = fit_chain(doc, which, y, ids, len(chosen)) if len(y) else None
    kind = pa.struct([(c, pa.float64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                n, dense = part.num_rows, np.zeros((part.num_rows, 0))
                doc, which = presence(part.column(text_col), chosen)
                out = []
                for w in models or []:
                    p = sparse_chance(doc, which, dense, w, n)
                    out.append(p)
                    dense = np.concatenate([dense, _logit(p)], 1)
                out = out or [np.zeros(n)] * len(names)
                column = pa.StructArray.from_arrays([pa.array(x) for x in out], names=names)
                yield pa.RecordBatch.from_arrays([*part.columns, column.cast(kind)], names=[*part.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StructType([T.StructField(c, T.DoubleType()) for c in names]))]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """One row per row of `docs`: id, probability of each category, toxic, kept (not toxic)."""
    found = score(docs.select(id_col, text_col), labels, id_col, text_col, **options)
    names = found.schema["_chain"].dataType.names
    toxic = F.col("_chain.toxic") >= threshold
    return found.select(id_col, *(F.round(f"_chain.{c}", 6).alias(f"p_{c}") for c in names), toxic.alias("toxic"), (~toxic).alias("kept"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` that aren't toxic, with their columns unchanged."""
    name = fresh(docs, "_chain")
    return score(docs, labels, out_col=name, **options).where(F.col(f"{name}.toxic") < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
