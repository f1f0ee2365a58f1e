"""Quality selection by importance resampling: target against raw hashed n-gram models, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import LETTER_DIGIT, LOWER, SpanHash, U, byte_class, flatten, mix, slices, split_ranges, word_spans

BUCKETS = 10_000
_BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token and each pair of neighbouring tokens, the range of each text, and its number of words.

    Tokens are lower-cased runs of letters and digits, and runs of other non-blank characters.
    """
    data, offsets = flatten(texts)
    data = LOWER[data]
    spans = SpanHash(data)
    start, end, at = word_spans(data, offsets, LETTER_DIGIT)
    other_start, other_end, _ = word_spans(data, offsets, ~LETTER_DIGIT & ~_BLANK)
    starts = np.concatenate([start, other_start])
    order = np.argsort(starts, kind="stable")
    tokens = spans(starts, np.concatenate([end, other_end]))[order]
    to = np.searchsorted(starts[order], offsets)
    one = tokens % U(BUCKETS)
    pair = mix(tokens[:-1] * U(0xFF51AFD7ED558CCD) + tokens[1:]) % U(BUCKETS) if len(tokens) else tokens
    inside = np.ones(max(len(tokens) - 1, 0), bool)
    inside[to[1:-1][(to[1:-1] > 0) & (to[1:-1] < len(tokens))] - 1] = False
    first = np.flatnonzero(inside)
    place = np.concatenate([np.arange(len(tokens)), first + 0.5])
    by = np.argsort(place, kind="stable")
    return np.concatenate([one, pair[first]])[by].astype(np.int64), np.searchsorted(place[by], to, side="left"), np.diff(at)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            sums += np.bincount(ngram_buckets(part.column("text"))[0], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums)], names=["bucket", "n"])


def _target_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _totals over the rows that are wanted; bucket BUCKETS counts them, the next one all rows."""
    sums = np.zeros(BUCKETS + 2, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            wanted = part.filter(part.column("wanted"))
            sums[:BUCKETS] += np.bincount(ngram_buckets(wanted.column("text"))[0], minlength=BUCKETS)
            sums[BUCKETS:] += wanted.num_rows, part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 2)), pa.array(sums)], names=["bucket", "n"])


def _counts(rows: DataFrame, totals, size: int) -> np.ndarray:
    """Sums of the buckets over all tasks; `size` numbers, whatever the input."""
    out = np.zeros(size, np.int64)
    for r in rows.mapInArrow(totals, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _model(counts: np.ndarray) -> np.ndarray:
    """Log shares of the buckets, with one added to each count."""
    return np.log((counts + 1) / (counts + 1).sum())


def labelled_texts(docs: DataFrame, labels: DataFrame, target: Column, id_col: str, text_col: str) -> DataFrame:
    """Text and wanted of every row with a labelled id; an id with several labels is wanted if all of them are.

    The labels are hashed and the texts dealt out at every size, so that no table has to fit a task.
    """
    marks = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("lid"), target.alias("wanted")).dropna().groupBy("lid").agg(F.min("wanted").alias("wanted"))
    own = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return own.join(marks.hint("shuffle_hash"), "lid").select("text", "wanted")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: Column | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """Keep the share of the documents that best resembles a target text, by Gumbel top-k.

    The log weight of a text is the sum over its tokens and token pairs of the log ratio of two
    generative models of hashed n-grams: of the target (all texts whose label meets `target`,
    quality = 1 by default) and of all texts. A
    Gumbel variate from a hash of id and seed is added; the round(share * rows) largest keys are
    kept, and any that tie with the last. `share` is that of the target among the labelled rows
    unless given. Without target texts all weights are 0 and the choice is uniform. A null or
    empty text has weight 0; a null id draws its variate as id 0 does not (from a hash of null).

    :return: one row per row of `docs`: id_col, n_words (long), log_weight, gumbel_key (double), kept.

    Two narrow passes over the texts and one join with the labels. The k-th largest key is found by counting, 16 bits of the
    key at a time, so no rows are sorted or gathered.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    target = F.col("quality") == 1 if target is None else target
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).alias("draw"), F.col(text_col).cast("string").alias("text"))
    counts = _counts(labelled_texts(docs, labels, target, id_col, text_col), _target_totals, BUCKETS + 2)
    n_wanted, n_labelled = int(counts[BUCKETS]), int(counts[BUCKETS + 1])
    if share is None:
        share = n_wanted / n_labelled if n_labelled else 1.0
    ratio = _model(counts[:BUCKETS]) - _model(_counts(texts.select("text"), _totals, BUCKETS)) if n_wanted else np.zeros(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, at, words = ngram_buckets(part.column("text"))
                sums = np.array([ratio[x].sum() for x in split_ranges(buckets, at)])
                draw = mix(part.column("draw").to_numpy(zero_copy_only=False).view(U))
                key = sums - np.log(-np.log((draw >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54))
                bits = key.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("own_id"), pa.array(words.astype(np.int64)), pa.array(sums), pa.array(key), pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))], names=["own_id", "n_words", "log_weight", "gumbel_key", "rank_bits"])

    scored = scratch.keep(texts.mapInArrow(run, "own_id long, n_words long, log_weight double, gumbel_key double, rank_bits long"))
    least = kth_largest(scored, "rank_bits", round(share * scored.count()))
    kept = F.col("rank_bits") >= F.lit(least) if least is not None else F.lit(False)
    return scored.select(F.col("own_id").alias(id_col), "n_words", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), kept.alias("kept"))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by four counts over 16 bits each; None for k < 1 or no rows."""
    if k < 1:
        return None
    base = 0
    for level in range(4):
        shift = 48 - 16 * level
        digit = F.shiftright(column, shift) if not level else F.shiftright(column, shift).bitwiseAND(0xFFFF)
        own = df if not level else df.where(F.shiftright(column, shift + 16) == base)
        counts = sorted(((r.d, r.n) for r in own.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        if not counts:
            return None
        for d, n in counts:
            last = d
            if k <= n:
                break
            k -= n
        base = last if not level else (base << 16) | last
    return base
