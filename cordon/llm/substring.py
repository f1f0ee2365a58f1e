"""Exact substring dedup by prefix-free parsing.

A rolling hash of GRAM bytes picks one trigger in every window of `length` bytes (its smallest
value, the rightmost of equals), so equal windows have equal triggers at equal distances. The
windows of one trigger are a phrase: a stretch of text that holds each of its windows whole.
The dictionary of distinct phrases keeps the first place of each in corpus order; a phrase that
stands elsewhere is removed there. Only phrases that share a trigger with another phrase of the
dictionary can share single windows with it. Their suffixes, cut at `length` bytes, are sorted
together with the places they come from in corpus order, and all but the first are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textkit import SpanHash, U, flatten, mix, slices

GRAM = 24
#: Phrases a task holds before it sends them on; equal ones among them are sent once.
FLUSH = 1 << 18
LAST = (1 << 63) - 1
# place: first byte of the first window (32 bits), hash of the text (16), windows (7), trigger's distance (7), already known to be removed (1)
ROW = "gram long, phrase long, id long, place long"


def _pack(start, mark, windows, distance, known=0):
    return (start << 31) | (mark << 15) | (windows << 8) | (distance << 1) | known


def _start(place):
    return place >> 31


def _windows(place):
    return (place >> 8) & 127


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Trigger hash, phrase hash, text, first byte, number of windows and trigger's distance of each phrase."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(U), none.astype(U), none, none, none, none
    spans = SpanHash(data)
    low = spans.order(GRAM) << U(32)
    low |= U(0xFFFFFFFF) - np.arange(len(low), dtype=U)
    width, reach = length - GRAM + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: reach - width], low[width - reach :])
    trigger = (U(0xFFFFFFFF) - (low & U(0xFFFFFFFF))).astype(np.int64)
    n = len(trigger)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.arange(n) + length <= offsets[doc + 1] - 1
    new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])])
    start = np.flatnonzero(new & whole)
    sums = np.concatenate([[0], np.cumsum(whole)])
    borders = np.concatenate([np.flatnonzero(new), [n]])
    count = sums[borders[np.searchsorted(borders, start, side="right")]] - sums[start]
    return spans(trigger[start], trigger[start] + GRAM), spans(start, start + count - 1 + length), doc[start], start - offsets[doc[start]], count, trigger[start] - start


def _parse(text: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = flatten(part.column(text))
                gram, phrase, doc, start, count, distance = _phrases(data, offsets, length)
                if len(gram):
                    marks = (mix(SpanHash(data)(offsets[:-1], offsets[1:])) & U(0xFFFF)).astype(np.int64)
                    held.append((gram, phrase, part.column("id").to_numpy(zero_copy_only=False)[doc], _pack(start, marks[doc], count, distance)))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield _sent(held)
                    held = []
        if held:
            yield _sent(held)

    return run


def _sent(held: list[tuple]) -> pa.RecordBatch:
    """Rows to deal out by trigger. What repeats an earlier row is marked, and dealt by document instead."""
    gram, phrase, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, ids, phrase, gram))
    gram, phrase, ids, place = gram[order], phrase[order], ids[order], place[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    known = (ids != ids[first]) | (_start(place) != _start(place[first]))
    gram = np.where(known, mix(ids.astype(U)), gram)
    return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(ids), pa.array(place | known)], names=["gram", "phrase", "id", "place"])


class _Marker:
    """Reads rows sorted by gram, phrase, id, place. kind 1: the phrase stands earlier; kind 2: it is
    the first of its phrase, and its trigger has another phrase. Holds the rows of one phrase's first place only."""

    def __init__(self):
        self.gram = self.phrase = self.first_id = self.first_start = None
        self.count, self.waiting = 0, []

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, p, i, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "phrase", "id", "place"))
            known = (s & 1) == 1
            out = [(i[known], s[known], np.ones(known.sum(), np.int8))]
            g, p, i, s = g[~known], p[~known], i[~known], s[~known]
            if len(g):
                out += self._marked(g, p, i, s)
            ids, places, kinds = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places), pa.array(kinds)], names=["id", "place", "kind"])

    def _marked(self, g, p, i, s) -> list[tuple]:
        out, start = [], _start(s)
        new_gram = np.concatenate([[g[0] != self.gram], g[1:] != g[:-1]])
        new = new_gram | np.concatenate([[p[0] != self.phrase], p[1:] != p[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
        first_id = np.where(first < 0, self.first_id if self.first_id is not None else 0, i[first])
        first_start = np.where(first < 0, self.first_start if self.first_start is not None else 0, start[first])
        later = (i != first_id) | (start != first_start)
        run = np.cumsum(new_gram)
        count = np.bincount(run, weights=new).astype(np.int64)
        count[0] += self.count
        if self.waiting and count[0] > 1:
            out.append((*map(np.array, zip(*self.waiting, strict=True)), np.full(len(self.waiting), 2, np.int8)))
        if count[0] > 1 or new_gram.any():
            self.waiting = []
        shared = count[run] > 1
        kind = np.where(later, 1, np.where(shared, 2, 0)).astype(np.int8)
        out.append((i[kind > 0], s[kind > 0], kind[kind > 0]))
        if count[run[-1]] == 1:
            rest = np.flatnonzero((run == run[-1]) & ~later)
            self.waiting += list(zip(i[rest].tolist(), s[rest].tolist(), strict=True))
        self.gram, self.phrase, self.count = g[-1], p[-1], int(count[run[-1]])
        self.first_id, self.first_start = first_id[-1], first_start[-1]
        return out


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _Marker()(batches)


def _contexts(text: str, length: int):
    """Bytes of the phrases listed in `places`, with the hash of their trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = flatten(part.column(text))
                spans = SpanHash(data)
                marks = (mix(spans(offsets[:-1], offsets[1:])) & U(0xFFFF)).astype(np.int64)
                lists = part.column("places")
                places = lists.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                own = ((places >> 15) & 0xFFFF) == marks[doc]
                places, doc = places[own], doc[own]
                start = offsets[doc] + _start(places)
                trigger = start + ((places >> 1) & 127)
                end = start + _windows(places) - 1 + length
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spans(trigger, trigger + GRAM).view(np.int64)), pa.array(part.column("id").to_numpy(zero_copy_only=False)[doc]), pa.array(places), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
                    names=["gram", "id", "place", "bytes"],
                )

    return run


def _suffixes(length: int):
    """The windows of each phrase, with two hashes of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "bytes"):
                data, offsets = flatten(part.column("bytes"))
                place = part.column("place").to_numpy()
                count = _windows(place)
                row = np.repeat(np.arange(len(place)), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = offsets[row] + step
                one, two = SpanHash(data)(at, at + length), SpanHash(data, 77)(at, at + length)
                where = _pack(_start(place)[row] + step, (place[row] >> 15) & 0xFFFF, 1, 0)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(part.column("id").to_numpy()[row]), pa.array(where)], names=["gram", "phrase", "id", "place"])

    return run


def _removed(text: str, length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = flatten(part.column(text))
                marks = ((mix(SpanHash(data)(offsets[:-1], offsets[1:])) & U(0xFFFF)).astype(np.int64)).tolist()
                lists, raw, rows = part.column("places"), data.tobytes(), []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = raw[a : b - 1]
                    spans: list[list[int]] = []
                    if lists[k].is_valid:
                        places = np.sort(lists[k].values.to_numpy(zero_copy_only=False))
                        places = places[((places >> 15) & 0xFFFF) == marks[k]]
                        for s, e in zip(_start(places).tolist(), (_start(places) + _windows(places) - 1 + length).tolist(), strict=True):
                            if spans and s <= spans[-1][1]:
                                spans[-1][1] = max(e, spans[-1][1])
                            else:
                                spans.append([s, e])
                    kept = b"".join(own[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(own)], strict=True))
                    rows.append((len(own), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
                yield pa.RecordBatch.from_arrays([part.column("own_id"), *columns[: 5 if with_bytes else 4]], names=["own_id", *names[: 5 if with_bytes else 4]])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier.

    Earlier: in a document of smaller id, or earlier in the same document. Strings are judged on
    the input, not on what is left, and never cross documents. Texts are UTF-8 bytes; a null or
    empty text has none, a text shorter than `length` loses none. Rows that repeat an id are one
    document: equal strings at equal places of them aren't earlier than one another. A null id
    counts as larger than all others. Other columns of `docs` are ignored.

    :return: one row per row of `docs`: id_col, n_bytes, n_removed, n_spans (maximal removed
        runs), kept_sha256 (of the remaining bytes); with_bytes adds them as kept_bytes.

    A phrase is a row of two hashes and a place, and there is one for about `length` / 3 bytes.
    They are shuffled once and sorted, and repeats found within a task are not dealt by their
    trigger, so a passage of many documents costs a task's share a row, not a document's. Hashes
    are compared 128 bits at a time; texts are fetched only for the phrases that stand in doubt.
    """
    if not 2 * GRAM <= length <= 127:
        raise ValueError(f"length must be from {2 * GRAM} to 127")
    scratch = Scratch(docs.sparkSession, "substring")
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    by = ["gram", "phrase", "id", "place"]
    found = texts.where(F.octet_length("text") >= length).select("id", "text").mapInArrow(_parse("text", length), ROW)
    marked = scratch.keep(found.repartition("gram").sortWithinPartitions(*by).mapInArrow(_mark, "id long, place long, kind byte"))

    listed = lambda df: df.groupBy("id").agg(F.collect_list("place").alias("places"))
    doubtful = texts.select("id", "text").join(listed(marked.where("kind = 2")), "id")
    contexts = doubtful.mapInArrow(_contexts("text", length), "gram long, id long, place long, bytes binary")
    windows = contexts.repartition("gram").mapInArrow(_suffixes(length), ROW).sortWithinPartitions(*by)
    single = scratch.keep(windows.mapInArrow(_mark, "id long, place long, kind byte").where("kind = 1").select("id", "place"))

    gone = listed(marked.where("kind = 1").select("id", "place").unionByName(single))
    out = T.StructType([T.StructField("own_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    if with_bytes:
        out = out.add("kept_bytes", T.BinaryType())
    return texts.join(gone, "id", "left").select("own_id", "text", "places").mapInArrow(_removed("text", length, with_bytes), out).withColumnRenamed("own_id", id_col)
