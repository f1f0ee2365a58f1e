"""Benchmark decontamination: an FM-index of each training shard, searched for all test phrases.

A shard is about SHARD_BYTES of documents of a task. All its words are symbols of one text, and its
index (suffix array, wavelet matrix over the Burrows-Wheeler transform, sampled positions) is
built once and searched backwards for every phrase. Words are looked up by hashes; what is found
is compared byte for byte before it counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fmindex import FMIndex
from .scratch import Scratch, fresh
from .textkit import LETTER_DIGIT, LOWER, SLICE_BYTES, slices, word_hashes

#: Bytes of phrases and item ids in one broadcast, and broadcasts that one pass over the documents searches for.
BLOCK_BYTES, BLOCKS = 4 << 20, 8
#: Bytes of document text in one index; a longer document is an index of its own.
SHARD_BYTES = 4 * SLICE_BYTES
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))
_REPORT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())])))])


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(LOWER.tobytes()))


def _windows(window: int):
    """The phrases of items: words joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                phrases, owner = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    words = _words(text)
                    n = min(window, len(words))
                    phrases += [b" ".join(words[j : j + n]) for j in range(len(words) - n + 1 if n else 0)]
                    owner += [k] * (len(phrases) - len(owner))
                yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), part.column("item").take(pa.array(owner, pa.int64()))], names=["phrase", "item"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, scratch: Scratch) -> Iterator[dict[bytes, list[str]]]:
    """Phrases with the items that hold them, about BLOCK_BYTES at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    phrases = scratch.keep(items.mapInArrow(_windows(window), "phrase binary, item string").groupBy("phrase").agg(F.collect_set("item").alias("items")))
    total = phrases.agg(F.sum(F.octet_length("phrase") + F.octet_length(F.concat_ws(",", "items")) + 64)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        rows = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k).collect()
        if rows:
            yield {bytes(r.phrase): sorted(r["items"]) for r in rows}


def _patterns(block: dict[bytes, list[str]]) -> list[tuple[np.ndarray, list[bytes]]]:
    """For each number of words: the words' hashes of the phrases, one row each, and the phrases."""
    own = defaultdict(list)
    for phrase in block:
        own[phrase.count(b" ") + 1].append(phrase)
    return [(word_hashes(pa.array(x, pa.binary()), LETTER_DIGIT)[0].reshape(len(x), n), x) for n, x in sorted(own.items())]


def _search(part: pa.RecordBatch, text: str, sizes: np.ndarray, words: np.ndarray, blocks: list) -> dict[int, tuple[list, set]]:
    """Word ranges and items of the phrases in each text of a shard."""
    out: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
    if not len(words) or not blocks:
        return out
    vocabulary, symbols = np.unique(words, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])  # every text ends with the separator, symbol 1
    shard = np.ones(start[-1], np.int64)
    shard[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols + 2
    index = FMIndex(shard)
    known: dict[int, list[bytes]] = {}
    for block, patterns in blocks:
        for hashes, phrases in patterns:
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            there = np.flatnonzero((vocabulary[place] == hashes).all(1))
            low, high = index.search(place[there] + 2)
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            rows = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = index.locate(rows)
            doc = np.searchsorted(start, at, side="right") - 1
            n = hashes.shape[1]
            for d, w, p in zip(doc.tolist(), (at - start[doc]).tolist(), np.repeat(there[hit], count).tolist(), strict=True):
                if d not in known:
                    known[d] = _words(part.column(text)[d].as_py())
                if b" ".join(known[d][w : w + n]) == phrases[p]:
                    out[d][0].append((w, w + n))
                    out[d][1].update(block[phrases[p]])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"first_word": a, "end_word": b} for a, b in out]


def _pass(docs: DataFrame, text_col: str, out_col: str, blocks: list[dict], more: bool) -> DataFrame:
    """One search over all documents; `more`: out_col holds what earlier ones found."""
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(b.value, _patterns(b.value)) for b in shared]
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                parsed = [word_hashes(x.column(text_col), LETTER_DIGIT) for x in slices(part, text_col)]
                sizes = np.concatenate([np.diff(x[1]) for x in parsed])
                hits = _search(part, text_col, sizes, np.concatenate([x[0] for x in parsed]), ready)
                before = part.column(out_col).to_pylist() if more else [None] * part.num_rows
                rows = []
                for d, size in enumerate(sizes.tolist()):
                    spans, items = hits.get(d, ((), ()))
                    if before[d]:
                        spans, items = [*spans, *((x["first_word"], x["end_word"]) for x in before[d]["spans"])], {*items, *before[d]["items"]}
                    spans = _merged(spans)
                    rows.append({"n_words": size, "n_hit": sum(s["end_word"] - s["first_word"] for s in spans), "items": list(items), "spans": spans})
                names = [c for c in part.schema.names if c != out_col]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows, _ARROW)], names=[*names, out_col])

    fields = [f for f in docs.schema.fields if f.name != out_col]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, _REPORT)]))


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, out_col: str = "_contamination") -> DataFrame:
    """Occurrences of test phrases in every text.

    Words are lower-cased (A-Z) runs of 0-9, a-z and characters outside ASCII. A phrase is a
    window of `window` consecutive words of an item, or all words of a shorter one; an item
    without words or of null text has none. An item of null id is searched for like others, but
    isn't listed. Texts and items may be empty, null or repeated (each row is judged by itself);
    a null text has no words; a text of any length is searched whole. An empty benchmark leaves
    every text without a hit, and an empty table gives no rows.

    :return: all columns and rows of `docs` (none is renamed) and the struct column `out_col`,
        whose name must be new: n_words, n_hit (words inside an occurrence), items (ids with an
        occurring phrase, as strings, unordered), spans (merged, as word ranges).

    One narrow pass, no shuffle of documents. The phrases are made by Spark and broadcast in
    blocks of about BLOCK_BYTES, BLOCKS at a time; a benchmark of more phrases than that takes
    more passes, each of which builds the indexes once.
    """
    if fresh(docs, out_col) != out_col:
        raise ValueError(f"documents have a column {out_col} already")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    out, more, held = docs, False, []
    for block in _blocks(benchmark, item_col, item_text_col, window, scratch):
        if len(held) == BLOCKS:
            out, more, held = scratch.keep(_pass(out, text_col, out_col, held, more)), True, []
        held.append(block)
    return _pass(out, text_col, out_col, held, more)


def contaminated(out_col: str = "_contamination") -> Column:
    """The rule: at least one word in twenty of a text lies inside an occurrence."""
    return (F.col(f"{out_col}.n_hit") > 0) & (20 * F.col(f"{out_col}.n_hit") >= F.col(f"{out_col}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their columns unchanged. Options are those of scan()."""
    name = fresh(docs, "_contamination")
    return scan(docs, benchmark, out_col=name, **options).where(~contaminated(name)).select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    hit = "_contamination"
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, text_col="text", out_col=hit, **options)
    return found.select(
        F.col("id").alias(id_col), f"{hit}.n_words", f"{hit}.n_hit", F.size(f"{hit}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f"{hit}.items")), 256).alias("items_sha256"), contaminated().alias("contaminated"), f"{hit}.spans",
    )
