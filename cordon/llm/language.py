"""Language identification: a bidirectional recurrent network labels every byte, a text pools its bytes."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bigru import LENGTH, position_scores, train
from .textkit import LOWER, byte_class, flatten, slices

#: Bounds of the training sample: languages, documents and segments of LENGTH bytes for each.
MAX_LANGUAGES, MAX_DOCS, MAX_SEGMENTS = 200, 150, 1500
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_BLOCK = 2048


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of LENGTH lower-cased bytes, zero-padded, as [LENGTH, n]; the letters among them; and each segment's text."""
    data, offsets = flatten(texts)
    size = np.diff(offsets) - 1
    count = -(-size // LENGTH)
    doc = np.repeat(np.arange(len(size)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[doc] + step * LENGTH
    at = start[None, :] + np.arange(LENGTH)[:, None]
    inside = at < (offsets[1:] - 1)[doc][None, :]
    raw = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(inside, LOWER[raw], 0).astype(np.uint8), inside & _LETTER[raw], doc


def _training(docs: DataFrame, text_col: str, lang_col: str, id_col: str, max_languages: int, max_docs: int, max_segments: int) -> tuple[list[str], tuple]:
    own = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        warnings.warn(f"more than {max_languages} languages: the rarer ones are never predicted, unless max_languages is raised", stacklevel=3)
        counts = counts[:max_languages]
    languages = sorted(r.lang for r in counts)
    if not languages:
        return [], ()
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, max_docs / r.n))))
    each = {r.lang: min(200, max(8, -(-max_segments // max(1, min(max_docs, r.n))))) for r in counts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, letters, doc = segments(part.column("text"))
                lang, h = part.column("lang").to_pylist(), part.column("h").to_pylist()
                for k in range(part.num_rows):
                    mine = np.flatnonzero((doc == k) & (letters.sum(0) >= 8))
                    if len(mine):
                        mine = mine[np.unique(np.linspace(0, len(mine) - 1, min(len(mine), each[lang[k]])).astype(int))]
                        yield pa.RecordBatch.from_arrays([pa.array([lang[k]] * len(mine)), pa.array([h[k]] * len(mine)), pa.array([x[:, j].tobytes() for j in mine], pa.binary())], names=["lang", "h", "segment"])

    sample = own.where(F.pmod("h", F.lit(1 << 20)) <= share[F.col("lang")] * (1 << 20))
    got = sample.mapInArrow(run, "lang string, h long, segment binary").toArrow().to_pandas().sort_values(["lang", "h", "segment"])
    if len(got):
        got = pd.concat([x.iloc[np.unique(np.linspace(0, len(x) - 1, min(len(x), max_segments)).astype(int))] for _, x in got.groupby("lang")])
    if not len(got):
        return [], ()
    data = np.frombuffer(b"".join(got.segment), np.uint8).reshape(-1, LENGTH).T.copy()
    place = {x: k for k, x in enumerate(languages)}
    return languages, (data, _LETTER[data], np.array([place[x] for x in got.lang]))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES, max_docs: int = MAX_DOCS, max_segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """The language of every text.

    The network is fitted on the driver, on a sample of the documents that held_out() leaves and
    that have a language: at most `max_docs` documents (in expectation) and `max_segments` segments
    of each of the `max_languages` commonest languages; a warning says if there are more. Ids choose the sample, and are no input of
    the network. Then every byte of every text is labelled, in segments of LENGTH bytes, and the
    probabilities of a text's letters are averaged.

    :return: one row per row of `docs`: id_col, held_out, lang_pred (a learned value; `und` for
        a text that is null or has no letter, or if nothing could be learned), score (mean
        probability of that language, 0 to 1; 0 for `und`).

    One narrow pass after the fit; the network is a few thousand numbers in the task. A null id
    is neither learned from nor held out. Rows are judged one by one, so repeated rows get equal results; texts of any
    length are read whole; other columns are not read, whatever their names. An empty table gives no rows.
    """
    languages, data = _training(docs, text_col, lang_col, id_col, max_languages, max_docs, max_segments)
    weights = train(*data, len(languages)) if languages else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                n, k = part.num_rows, max(1, len(languages))
                sums, letters = np.zeros((n, k)), np.zeros(n)
                if weights is not None:
                    x, mask, doc = segments(part.column("text"))
                    for a in range(0, len(doc), _BLOCK):
                        p = position_scores(weights, x[:, a : a + _BLOCK])
                        p *= mask[:, a : a + _BLOCK, None]
                        s, own = p.sum(0), doc[a : a + _BLOCK]
                        for j in range(k):
                            sums[:, j] += np.bincount(own, weights=s[:, j], minlength=n)
                        letters += np.bincount(own, weights=mask[:, a : a + _BLOCK].sum(0), minlength=n)
                best = sums.argmax(1)
                score = np.clip(sums[np.arange(n), best] / np.maximum(letters, 1), 0, 1)
                flat = flatten(part.column("text"))[0]
                plain = not (flat >= 0x80).any()
                texts = part.column("text") if not plain else None
                known = [bool(c) and (plain or any(ch.isalpha() for ch in texts[i].as_py())) for i, c in enumerate(letters)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("own_id"), part.column("held_out"), pa.array([languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))],
                    names=["own_id", "held_out", "lang_pred", "score"],
                )

    own = docs.select(F.col(id_col).alias("own_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["own_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema).withColumnRenamed("own_id", id_col)
