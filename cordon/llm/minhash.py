"""Near-duplicate groups by HyperMinHash.

Each text gets GROUPS x 4 registers: in group g every shingle falls into one of four buckets by
the top bits of its g-th hash, and the bucket keeps the leading-zero count (6 bits) and the next
10 mantissa bits of its smallest value. One group of the first BANDS is one band: its four
16-bit registers are the band key. Texts that share a band key are compared with a hub of that
key, first by the collision-corrected Jaccard estimate of all registers, then on full shingle sets.
What hubs leave apart is paired by a prefix join that misses no similar pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textkit import BLANK_SPLIT, LOWER, SpanHash, U, flatten, mix, shingles, slices, split_ranges, word_hashes, word_spans

GROUPS, BANDS, BUCKETS, MANTISSA = 64, 32, 4, 10
EMPTY = 0xFFFF
#: A pair of similarity s is let through unless its estimate is this many standard errors too low.
MARGIN = 5.0
#: Members compared with one copy of a hub's text.
CHUNK = 256
#: 64-bit words of a text's bitmap of shingles.
BITMAP = 32
#: Texts of one shingle's bucket that a task takes as one side of a join.
BUCKET = 1000
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (GROUPS, 2), dtype=np.int64).astype(U) | U(1)


def registers(hashes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Registers of every text, uint16[texts, GROUPS * BUCKETS]; EMPTY where no shingle fell into the bucket."""
    n = len(to) - 1
    out = np.full((n, GROUPS * BUCKETS), EMPTY, np.uint16)
    full = np.flatnonzero(np.diff(to))
    if not len(full):
        return out
    at = to[:-1][full]
    for g, (a, b) in enumerate(_SEEDS):
        x = hashes * a
        x = (x ^ (x >> U(32))) * b
        for k in range(BUCKETS):
            low = np.minimum.reduceat(x ^ U(k << 62), at)
            bits = np.maximum(low, U(1)).astype(np.float64).view(U)
            level = U(61) - np.minimum((bits >> U(52)) - U(1023), U(61))
            reg = (level << U(MANTISSA)) | ((bits >> U(52 - MANTISSA)) & U((1 << MANTISSA) - 1))
            out[full, g * BUCKETS + k] = np.where(low >> U(62), U(EMPTY), reg)
    return out


@cache
def _collisions() -> np.ndarray:
    """Chance that unequal minima of n and m values share a register, by log2 of n and m."""
    cells = np.concatenate([2.0**-j * (0.5 + (np.arange(8) + 0.5) / 16) for j in range(62)])
    width = np.concatenate([np.full(8, 2.0**-j / 16) for j in range(62)])
    sizes = 2.0 ** np.arange(0, 31)
    density = sizes[:, None] * np.exp((sizes[:, None] - 1) * np.log1p(-cells)[None, :])
    return (density[:, None, :] * density[None, :, :] * (width * width / (1 << (MANTISSA - 3)))[None, None, :]).sum(-1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of pairs of register rows, and the number of buckets it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(1)
    count = np.maximum(used.sum(1), 1)
    at = lambda x: np.clip(np.round(np.log2(np.maximum(x, BUCKETS) / BUCKETS)), 0, 30).astype(int)
    chance = _collisions()[at(n), at(m)]
    share = same / count
    return np.clip((share - chance) / (1 - chance), 0, 1), count


def _signatures(text: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = flatten(part.column(text))
                data = LOWER[data]
                start, end, at = word_spans(data, offsets, BLANK_SPLIT)
                hashes, to = shingles(SpanHash(data)(start, end), at, n)
                regs = registers(hashes, to)
                size = [len(np.unique(x)) for x in split_ranges(hashes, to)]
                # the words, one separator after each, are digested: texts of equal words are equal texts
                word = BLANK_SPLIT[data]
                shown = word | np.concatenate([[False], word[:-1]])
                flat = np.where(word, data, 10)[shown].tobytes()
                ends = np.concatenate([[0], np.cumsum(shown)])[offsets].tolist()
                words = [hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), pa.array(words, pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())], names=["id", "n_shingles", "words", "regs"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=U))
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), U).reshape(-1, GROUPS)[:, :BANDS]
            keys = mix(regs + salt[None, :]).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["band", "id"])


def _plausible(threshold: float, margin: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                a, b = (np.frombuffer(b"".join(x[c]), np.uint16).reshape(-1, GROUPS * BUCKETS) for c in ("ra", "rb"))
                guess, count = estimate(a, b, x.na.to_numpy(), x.nb.to_numpy())
                small, large = np.minimum(x.na, x.nb).to_numpy(), np.maximum(x.na, x.nb).to_numpy()
                near = guess >= threshold - margin * np.sqrt(threshold * (1 - threshold) / count) - 1e-9
                yield x.loc[near & (small >= threshold * large - 1e-6), ["a", "b"]]

    return run


def _sets(texts: pa.Array, n: int, salt: int) -> list[np.ndarray]:
    return [np.unique(x) for x in split_ranges(*shingles(*word_hashes(texts, BLANK_SPLIT, salt=salt), n))]


def _verify(text: str, n: int, percent: int):
    """Rows sorted by hub, chunk, role: a hub's texts come before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []
        for batch in batches:
            for part in slices(batch, text):
                # bases of their own: what signatures and bands take for equal is judged anew
                sets = _sets(part.column(text), n, salt=1)
                a, b = [], []
                for hub, chunk, role, id_, own in zip(*(part.column(c).to_pylist() for c in ("hub", "chunk", "role", "id")), sets, strict=True):
                    if (hub, chunk) != now:
                        now, hubs = (hub, chunk), []
                    if role == 0:
                        hubs.append(own)
                        continue
                    for other in hubs:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(other) - both):
                            a.append(id_)
                            b.append(hub)
                            break
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, margin: float | None = MARGIN) -> DataFrame:
    """Groups of texts whose word-shingle sets have a Jaccard similarity of `percent` / 100 or more.

    Words are lower-cased (A-Z) runs of non-blank characters; a text of fewer than `ngram` words
    is one shingle, a text without words or a null text has none and is linked with nothing.
    Rows that repeat an id are one document: it has the links of each of its rows. Rows with a
    null id are never linked and have a null component. Other columns of `docs` are ignored,
    whatever their names. Very long texts are taken whole; an empty table gives no rows.

    :return: one row per row of `docs`: id_col, n_shingles (long), component_id (smallest id
        reachable over links, itself included), kept (component_id equals the id; true for a null id).

    Texts of equal words (by a 128-bit digest) are grouped first and stand for one another, so a
    large group of copies costs a row each, not a pair each. Then each band key links its members
    to one hub, and where they aren't in one component after that, to the hub with most links.
    Texts that are still apart from others of their band keys are paired by `_apart`. So a large
    group costs a pair a member and key, and beyond that only pairs that its rarest shingles,
    positions, lengths and bitmaps can't rule out.
    The chance that a pair of similarity 0.8 shares none of the bands is (1 - 0.8^4)^32 < 1e-7.
    A pair whose estimate is `margin` standard errors too low is not confirmed; with None every pair
    of fitting sizes is.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = scratch.keep(texts.mapInArrow(_signatures("text", ngram), "id long, n_shingles long, words binary, regs binary"))
    known = sigs.where("id is not null and n_shingles > 0")
    first = known.groupBy("words").agg(F.min("id").alias("rep"), F.min_by("regs", "id").alias("regs"), F.min("n_shingles").alias("n"))
    reps = scratch.keep(first.select(F.col("rep").alias("id"), "words", "regs", "n"))
    copies = known.join(reps.select("words", F.col("id").alias("rep")), "words").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    dealt = scratch.keep(reps.select("id", "regs").mapInArrow(_bands, "band long, id long"))
    shared = dealt.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", F.col("low").alias("hub"))
    rows = scratch.keep(dealt.join(scratch.keep(shared), "band"))
    scratch.drop(dealt)
    wanted = rows.select("id").distinct()
    pool = scratch.keep(texts.join(wanted, "id").dropDuplicates(["id", "text"]))
    regs = scratch.keep(reps.select("id", "regs", "n").join(wanted, "id"))

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        both = pairs.join(regs.toDF("a", "ra", "na"), "a").join(regs.toDF("b", "rb", "nb"), "b")
        near = scratch.keep(both.mapInPandas(_plausible(percent / 100, math.inf if margin is None else margin), "a long, b long").distinct())
        return scratch.keep(_confirm(near, pool, ngram, percent, scratch))

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of band keys whose members aren't all in one component."""
        tagged = rows.select("band", "id").join(roots, rows.id == roots.node, "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        mixed = tagged.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("band")
        return tagged.join(mixed, "band")

    found = compared(rows.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    roots = components(copies.unionByName(found), scratch)
    again = lambda: components(roots.toDF("a", "b").unionByName(found), scratch)
    open_ = scratch.keep(rooted(rows, roots))
    if not open_.isEmpty():
        links = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        best = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), (-F.col("id")).alias("first"), "id", "root")).alias("h")
        hubs = scratch.keep(open_.join(links, "id", "left").groupBy("band").agg(best).select("band", F.col("h.id").alias("hub"), F.col("h.root").alias("hub_root")))
        found = compared(open_.join(hubs, "band").where("root <> hub_root").select(F.col("id").alias("a"), F.col("hub").alias("b")))
        roots = roots if found.isEmpty() else again()
        members = scratch.keep(rooted(open_, roots).select("id", "root").distinct())
        found = compared(_apart(members, pool, ngram, percent, scratch))
        roots = roots if found.isEmpty() else again()
    scratch.only(sigs, roots)
    out = sigs.join(roots, sigs.id == roots.node, "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _shingle_rows(n: int):
    """A row for each shingle of each text, with the text's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), n, salt=1)
                size = np.array([len(x) for x in sets])
                row = np.repeat(np.arange(len(sets)), size)
                own = [pa.array(part.column(c).to_numpy(zero_copy_only=False)[row]) for c in ("id", "mark", "root")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size[row]), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "mark", "root", "n", "shingle"])

    return run


def _bitmaps(n: int):
    """A bitmap of each text's shingles: bit h is the parity of the number of shingles with hash h modulo its size.

    The exclusive-or of two bitmaps is that of the shingles in one text alone, so its bits are at most as many as those are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), n, salt=1)
                bits = np.zeros((len(sets), BITMAP), U)
                for row, x in zip(bits, sets, strict=True):
                    np.bitwise_xor.at(row, (x >> U(6)) % U(BITMAP), U(1) << (x & U(63)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "mark", "bits"])

    return run


def _meet(percent: int):
    """Rows sorted by shingle, part and side (0: one side, 1: the other, 2: both): pairs of a bucket that can be similar."""

    def pairs(one: list[pa.RecordBatch], two: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = ({c: np.concatenate([x.column(c).to_numpy() for x in side]) for c in ("id", "root", "n", "place")} for side in (one, two))
        bits = [np.frombuffer(b"".join(y for x in side for y in x.column("bits").to_pylist()), U).reshape(-1, BITMAP) for side in (one, two)]
        for k in range(0, len(a["id"]), 64):
            both = a["n"][k : k + 64, None] + b["n"]
            near = a["root"][k : k + 64, None] > b["root"]
            for side, x in ((a, slice(k, k + 64)), (b, slice(None))):
                left = side["n"][x] + 1 - side["place"][x]
                near &= (100 + percent) * (left[:, None] if side is a else left) >= percent * both
            near &= 100 * np.minimum(a["n"][k : k + 64, None], b["n"]) >= percent * np.maximum(a["n"][k : k + 64, None], b["n"])
            i, j = np.nonzero(near)
            for at in range(0, len(i), CHUNK * BITMAP):
                p, q = i[at : at + CHUNK * BITMAP], j[at : at + CHUNK * BITMAP]
                differ = np.bitwise_count(bits[0][k + p] ^ bits[1][q]).sum(1, dtype=np.int64)
                ok = (100 + percent) * differ <= (100 - percent) * both[p, q]
                if ok.any():
                    yield a["id"][k + p[ok]], b["id"][q[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, two = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            for x, y in pairs(one, two) if one and two else ():
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("shingle", "part", "side")])
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0).any(0)]))
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if (key := tuple(keys[:2, s])) != now:
                    yield from done()
                    now, one, two = key, [], []
                part = batch.slice(s, e - s)
                if keys[2, s] != 1:
                    one.append(part)
                if keys[2, s] != 0:
                    two.append(part)
                if keys[2, s] == 1:  # the first side is whole: the second goes by
                    yield from done()
                    two = []
        yield from done()

    return run


def _apart(members: DataFrame, pool: DataFrame, ngram: int, percent: int, scratch: Scratch) -> DataFrame:
    """Every pair (a, b) of the members (id, root) with different roots that can be similar.

    Shingles are ordered by how rare they are among the members. Of two similar texts of n and m
    shingles that share at least o, the first shared one in that order has a place of at most
    n - o + 1 in one text and m - o + 1 in the other. A pair that meets there is ruled out by
    its sizes, or by the bits in which the parity bitmaps of its shingles differ: at least as many
    shingles are in one text alone, and similarity allows only so many. That leaves few pairs below
    the threshold for texts of up to about a third as many shingles as a bitmap has bits (2,048),
    whatever the size of their family; longer texts leave more. Buckets of frequent shingles are
    joined in parts of BUCKET texts.
    """
    texts = scratch.keep(pool.join(members, "id").select("id", F.xxhash64("text").alias("mark"), "root", "text"))
    each = scratch.keep(texts.mapInArrow(_shingle_rows(ngram), "id long, mark long, root long, n long, shingle long"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("id", "mark").orderBy("often", "shingle")
    placed = each.join(often, "shingle").withColumn("place", F.row_number().over(order))
    # a partner has percent / 100 of the shingles at least
    first = placed.where((100 * (F.col("n") + 1 - F.col("place")) >= percent * F.col("n")) & (F.col("often") > 1)).drop("often")
    bits = texts.mapInArrow(_bitmaps(ngram), "id long, mark long, bits binary")
    first = scratch.keep(first.join(bits, ["id", "mark"]))
    scratch.drop(each)
    sizes = first.groupBy("shingle").agg(F.count("*").alias("size")).where(F.col("size") > 1).select("shingle", F.ceil(F.col("size") / BUCKET).alias("parts"))
    rows = first.join(scratch.keep(sizes), "shingle")
    columns = ["shingle", "id", "root", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), "bits"]
    side = lambda rows, part, k: rows.select(*columns, part.alias("part"), F.lit(k).cast("long").alias("side"))
    hot, own = rows.where("parts > 1"), F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts"))
    dealt = side(rows.where("parts = 1"), F.lit(0).cast("long"), 2).unionByName(side(hot, own, 0)).unionByName(side(hot, F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<long>")), 1))
    return dealt.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "side").mapInArrow(_meet(percent), "a long, b long").distinct()


def _confirm(pairs: DataFrame, pool: DataFrame, ngram: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose full sets are similar; b's text is repeated once for CHUNK partners."""
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = scratch.keep(pairs.join(size, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(3)), F.col("chunks")).cast("int").alias("chunk")))
    asked = dealt.select(F.col("a").alias("id"), F.col("b").alias("hub"), "chunk", F.lit(1).alias("role"))
    asked = asked.unionByName(dealt.select(F.col("b").alias("id"), F.col("b").alias("hub"), "chunk", F.lit(0).alias("role")).distinct())
    rows = asked.join(pool, "id").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "id")
    return rows.mapInArrow(_verify("text", ngram, percent), "a long, b long").distinct()
