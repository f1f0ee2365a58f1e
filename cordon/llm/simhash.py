"""Near-duplicate groups by SimHash, compared exactly in tiles.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Distinct
fingerprints are ordered by their number of set bits and cut into stripes; stripes meet only where
those numbers differ by the radius at most. Inside a pair of stripes, tiles of equal bit counts in
each 16-bit quarter are compared by exclusive-or and bit counts, unless their counts differ by more
than the radius in sum. Neither rule can lose a pair: each differing bit changes a count by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, fresh, quoted
from .textkit import BLANK_SPLIT, LOWER, U, flatten, slices, word_spans

#: Distinct fingerprints of one stripe, about.
STRIPE = 1 << 15
#: Fingerprints of one row while stripes are shuffled.
CHUNK = 512
#: Shingles hashed at a time; linked pairs held before they are reduced to a forest.
STEP, HELD = 1 << 16, 1 << 20
_SEED = 42


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes; 0 without any."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + STEP], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * count > len(hashes))))


def _fingerprints(text: str, out: str, n: int):
    """Adds the fingerprint (as a signed long) of every text; only the text column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = flatten(part.column(text))
                data = LOWER[data]
                start, end, at = word_spans(data, offsets, BLANK_SPLIT)
                # words with one blank after each: a shingle is one span
                word = BLANK_SPLIT[data]
                shown = word | np.concatenate([[False], word[:-1]])
                flat = np.where(word, data, 32)[shown].tobytes()
                place = np.concatenate([[0], np.cumsum(shown)])
                start, end = place[start], place[end]
                prints = np.zeros(part.num_rows, np.int64)
                for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if b > a:
                        last = max(b - n + 1, a + 1)
                        spans = zip(start[a:last].tolist(), end[np.minimum(np.arange(a, last) + n, b) - 1].tolist(), strict=True)
                        hashes = np.fromiter((xxhash.xxh64_intdigest(flat[s:e], _SEED) for s, e in spans), U, last - a)
                        prints[row] = np.array(fingerprint(hashes), U).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(c for c, name in zip(part.columns, part.schema.names, strict=True) if name != text), pa.array(prints)], names=[*(c for c in part.schema.names if c != text), out])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the links but the smallest ones."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        # the roots of both ends are moved too, so that chains shrink by halves
        for ends in (x, y):
            np.minimum.at(root, before[ends], low)
            np.minimum.at(root, ends, low)
        root = root[root]
        if (root == before).all():
            moved = root < np.arange(len(nodes))
            return nodes[moved], nodes[root[moved]]


def _tiles(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered by the bit counts of their quarters; the counts of each tile, and where tiles start and end."""
    quarters = np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = quarters @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(key, kind="stable")
    cuts = np.concatenate([np.flatnonzero(np.diff(key[order], prepend=-1)), [len(key)]])
    return prints[order], quarters[order][cuts[:-1]], cuts


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of the pairs of fingerprints (uint64) that differ in `radius` bits at most; within `left` where `right` is None."""
    own, counts, cuts = _tiles(left)
    other, other_counts, other_cuts = (own, counts, cuts) if right is None else _tiles(right)
    for i in range(len(counts)):
        apart = np.abs(other_counts - counts[i]).sum(1)
        if right is None:
            apart[:i] = radius + 1
        a = own[cuts[i] : cuts[i + 1]]
        for j in np.flatnonzero(apart <= radius):
            b = other[other_cuts[j] : other_cuts[j + 1]]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if right is None and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield a[x], b[y]


def _compare(radius: int):
    """Rows (pair, side, prints) sorted by pair and side: links inside each pair of stripes, as a forest of at most a row a fingerprint."""

    def links(sides: list[list[np.ndarray]], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = (np.concatenate(s) if s else np.zeros(0, U) for s in sides)
        a, b, held = [], [], 0
        for x, y in near_pairs(left, None if alone else right, radius):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > HELD:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        return forest(np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, [[], []]

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                x, y = links(sides, now[0] == now[1])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for p, q, side, prints in zip(*(batch.column(c) for c in ("p", "q", "side", "prints")), strict=True):
                if (pair := (p.as_py(), q.as_py())) != now:
                    yield from done()
                    now, sides = pair, [[], []]
                sides[side.as_py()].append(prints.values.to_numpy().view(U))
        yield from done()

    return run


def _links(prints: DataFrame, radius: int, stripe: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints (column `print`) within the radius."""
    ones = F.bit_count("print")
    sizes = {r.ones: r.n for r in prints.groupBy(ones.alias("ones")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    first, total = {}, 0  # stripes are numbered by rising bit count
    for k in range(65 + radius + 1):
        first[k] = total
        total += -(-sizes.get(k, 0) // stripe)
    lookup = lambda shift: F.element_at(F.array(*(F.lit(first[max(0, k + shift)]) for k in range(65))), ones.cast("int") + 1)
    own = lookup(0) + F.pmod(F.xxhash64("print"), F.greatest(lookup(1) - lookup(0), F.lit(1))).cast("int")
    dealt = prints.select("print", own.alias("stripe"), lookup(-radius).alias("low"), lookup(radius + 1).alias("high"))
    chunk = F.pmod(F.xxhash64("print", F.lit(1)), F.lit(-(-stripe // CHUNK)))
    rows = scratch.keep(dealt.groupBy("stripe", "low", "high", chunk.alias("chunk")).agg(F.collect_list("print").alias("prints")))
    # partners of a stripe are a range of numbers: it comes first with the later ones, second with the earlier ones
    one = rows.select(F.col("stripe").alias("p"), F.explode(F.sequence("stripe", F.col("high") - 1)).alias("q"), F.lit(0).alias("side"), "prints")
    two = rows.where("low < stripe").select(F.explode(F.sequence("low", F.col("stripe") - 1)).alias("p"), F.col("stripe").alias("q"), F.lit(1).alias("side"), "prints")
    met = one.unionByName(two).repartition("p", "q").sortWithinPartitions("p", "q", "side")
    return met.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, radius: int = 3, stripe: int = STRIPE) -> DataFrame:
    """Groups of texts whose SimHash fingerprints differ in `radius` bits at most.

    Words are lower-cased (A-Z) runs of non-blank characters, shingles `ngram` of them joined by
    blanks, repeats included; a shorter text is one shingle. A null text or one without words has
    fingerprint 0 and is linked like any other. Equal fingerprints stand for one another, so copies
    cost a row each. Rows that repeat an id are one document, with the links of each of its rows;
    rows with a null id are never linked and have a null component. Very long texts are taken
    whole; an empty table gives no rows; other columns are ignored, whatever their names.

    :return: one row per row of `docs`: id_col, fingerprint (16 hex digits), component_id (smallest id reachable).

    Tasks hold two stripes of about `stripe` fingerprints and give a forest of their links, never all pairs.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    rows = scratch.keep(texts.mapInArrow(_fingerprints("text", "print", ngram), "id long, print long"))
    known = rows.where("id is not null")
    prints = scratch.keep(known.select("print").distinct())
    # all fingerprints of a repeated id are linked with one of them
    per = known.groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").select("id", "low")
    same = known.join(per, "id").where("print <> low").select(F.col("print").alias("a"), F.col("low").alias("b"))
    links = scratch.keep(_links(prints, radius, stripe, scratch).unionByName(same))
    roots = components(links, scratch)
    lows = scratch.keep(known.groupBy("print").agg(F.min("id").alias("low")).join(roots.toDF("print", "root"), "print", "left").select("print", "low", F.coalesce("root", "print").alias("root")))
    first = scratch.keep(lows.groupBy("root").agg(F.min("low").alias("component_id")))
    named = scratch.keep(lows.join(first, "root").select("print", "component_id"))
    out = rows.join(named, "print", "left")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return out.select(F.col("id").alias(id_col), digits, F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
