"""Hard negatives by exact inner products, behind bounds from segment summaries.

A vector is cut into segments; each keeps its mean and deviation. For two segments of L entries the
inner product lies within L * (mean * mean) plus or minus L * (deviation * deviation), so the sums
over all segments bound a score. Coarse segments are tried first; pairs that their bounds can't
settle go on to finer ones, and what is left to the exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, numbered, quoted
from .whitening import usable

#: Segments of a vector by level; each level halves or quarters the one before.
LEVELS = (2, 8, 32)
#: Rows and anchors of one cell; anchors compared at a time.
ROWS, ANCHORS, AT_ONCE = 4096, 4096, 128
#: A level whose bounds leave fewer pairs than this share is followed by sparse work.
SPARSE = 0.2


def summaries(x: np.ndarray, levels: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the scaled means and deviations of the segments, so that bounds are plain inner products of them."""
    out, n = [], x.shape[1]
    for s in levels:
        cuts = np.unique(np.linspace(0, n, min(s, n) + 1).astype(int))
        length = np.diff(cuts)
        mean = np.add.reduceat(x, cuts[:-1], axis=1) / length
        square = np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, cuts[:-1], axis=1)
        out.append((mean * np.sqrt(length), np.sqrt(square)))
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, in floats where those hold them exactly, else in integers; more than 63 bits is an error."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("scores pass the range of a long")
    return a @ b.T


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Side:
    """Rows or anchors of a cell: integer vectors and their summaries."""

    def __init__(self, x: np.ndarray, levels: tuple[int, ...]):
        self.x = x
        self.levels = summaries(x.astype(float), levels)
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))

    def some(self, at: slice) -> Side:
        out = object.__new__(Side)
        out.x, out.norm, out.levels = self.x[at], self.norm[at], [(m[at], d[at]) for m, d in self.levels]
        return out


def survivors(a: Side, b: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, exact score) that can be among the k best of some range of their anchor, ties included.

    low, high: [anchors, ranges], bounds of the score (inclusive). A pair goes when its upper bound is
    below the k-th largest lower bound of pairs certain to be in range, or it can be in no range.
    """
    at = None  # all allowed pairs, or their indices once they are few
    slack = 1e-9 * a.norm[:, None] * b.norm[None, :].max(initial=0) + 1e-6
    for (am, ad), (bm, bd) in zip(a.levels, b.levels, strict=True):
        if at is None:
            middle, spread = am @ bm.T, ad @ bd.T + slack
            lower, upper = np.where(allowed, middle - spread, np.nan), np.where(allowed, middle + spread, -np.inf)
            keep = np.zeros(allowed.shape, bool)
            for r in range(low.shape[1]):
                lo, hi = low[:, r, None], high[:, r, None]
                sure = (lower >= lo) & (upper <= hi)
                bar = np.maximum(_kth(np.where(sure, lower, -np.inf), k)[:, None], lo)
                keep |= (upper >= bar) & (lower <= hi)
            allowed = keep
            if keep.mean() < SPARSE:
                at = np.nonzero(keep)
        else:
            i, j = at
            middle, spread = np.einsum("ps,ps->p", am[i], bm[j]), np.einsum("ps,ps->p", ad[i], bd[j]) + slack[i, 0]
            keep = np.zeros(len(i), bool)
            for r in range(low.shape[1]):
                keep |= (middle + spread >= low[i, r]) & (middle - spread <= high[i, r])
            at = i[keep], j[keep]
    if at is None:
        score = exact_scores(a.x, b.x)
        i, j = np.nonzero(allowed)
        return i, j, score[i, j]
    i, j = at
    out = np.zeros(len(i), np.int64)
    for c in range(0, len(i), ROWS):
        p, r = i[c : c + ROWS], j[c : c + ROWS]
        most = float(np.abs(a.x).max(initial=0)) * float(np.abs(b.x).max(initial=0)) * a.x.shape[1]
        if most >= 2**63:
            raise OverflowError("scores pass the range of a long")
        out[c : c + ROWS] = np.einsum("pd,pd->p", a.x[p], b.x[r])
    return i, j, out


def best(i: np.ndarray, j: np.ndarray, score: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each range r: (r, anchor, row, score) of the k best pairs of every anchor; of equal scores the row of smaller `order`."""
    for r in range(low.shape[1]):
        ok = np.flatnonzero((score >= low[i, r]) & (score <= high[i, r]))
        ok = ok[np.lexsort((order[j[ok]], -score[ok], i[ok]))]
        place = np.arange(len(ok)) - np.searchsorted(i[ok], i[ok], side="left")
        ok = ok[place < k]
        yield r, i[ok], j[ok], score[ok]


def _score(levels: tuple[int, ...], k: int, same: bool):
    """Cells of rows (side 0) and anchors (side 1), sorted by cell and side: the k best rows of each anchor and range in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, label, ids, number = None, [], None, None, None
        side = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            role = batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(cell, prepend=cell[0] - 1) != 0) | (np.diff(role, prepend=-1) != 0))
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(s, e - s)
                if cell[s] != now:
                    now, rows, side = cell[s], [], None
                if role[s] == 0:
                    rows.append(part)
                    continue
                if side is None:
                    if not rows:
                        continue
                    table = pa.Table.from_batches(rows)
                    side = Side(np.stack(table.column("x").to_numpy()), levels)
                    label, ids, number = (table.column(c).to_numpy() for c in ("label", "id", "number"))
                    order, rows = np.lexsort((number, ids)).argsort(), []
                own = Side(np.stack(part.column("x").to_numpy(zero_copy_only=False)), levels)
                own_label, own_number = part.column("label").to_numpy(), part.column("number").to_numpy()
                own_id = part.column("id").to_numpy()
                bound = [np.stack(part.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("low", "high")]
                for c in range(0, part.num_rows, AT_ONCE):
                    some = slice(c, c + AT_ONCE)
                    alike = own_label[some, None] == label[None, :]
                    allowed = alike & (own_number[some, None] != number[None, :]) if same else ~alike
                    low, high = (x[some] for x in bound)
                    i, j, score = survivors(own.some(some), side, allowed, low, high, k)
                    for r, p, q, v in best(i, j, score, order, low, high, k):
                        if len(p):
                            yield pa.RecordBatch.from_arrays([pa.array(own_number[some][p]), pa.array(own_id[some][p]), pa.array(np.full(len(p), r)), pa.array(number[q]), pa.array(ids[q]), pa.array(v)], names=["anchor", "anchor_id", "range", "row", "row_id", "score"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int, same: bool, levels: tuple[int, ...], cell_rows: int, cell_anchors: int) -> DataFrame:
    """The k best rows of every anchor and range (anchor, anchor_id, range, row, row_id, score), with rank.

    rows: number, id, label, x. anchors: these, part, low and high (arrays, a range each). Rows and
    anchors are cut into parts of fixed sizes and every part of one meets every part of the other
    in a cell; a cell gives at most k rows an anchor and range.
    """
    row_parts, anchor_parts = -(-n_rows // cell_rows), -(-n_anchors // cell_anchors)
    cell = lambda r, a: (r * anchor_parts + a).cast("long").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.array().cast("array<long>")
    one = rows.select("*", every(anchor_parts).alias("other")).select(cell(F.floor(F.col("number") / cell_rows), F.col("other")), F.lit(0).alias("side"), "number", "id", "label", "x", none.alias("low"), none.alias("high"))
    two = anchors.select("*", every(row_parts).alias("other")).select(cell(F.col("other"), F.col("part")), F.lit(1).alias("side"), "number", "id", "label", "x", "low", "high")
    met = one.unionByName(two).repartition("cell").sortWithinPartitions("cell", "side")
    found = met.mapInArrow(_score(levels, k, same), "anchor long, anchor_id long, range long, row long, row_id long, score long")
    order = Window.partitionBy("anchor", "range").orderBy(F.desc("score"), "row_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "x", label_col: str = "label", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    levels: tuple[int, ...] = LEVELS, cell_rows: int = ROWS, cell_anchors: int = ANCHORS,
) -> DataFrame:
    """Hard negatives of every anchor and positive, by integer inner products.

    An anchor is a row for which `anchor` (over the columns of `vectors`) is true. Its positives are
    the `positives` best other rows of its label, its negatives for a positive the `negatives` best
    rows of another label whose score lies from `least` to `most` percent of the positive's. Higher
    scores come first; ties go to the smaller id, and rows of one id that tie to the one numbered first.

    Rows with a null id, label or vector take no part (`vec_col` holds integers; drop non-finite
    vectors before); an empty vector counts as null. Rows equal in id, label and vector are one
    row; rows of one id that differ are rows of their own. Vectors must be of one length (else
    ValueError). Empty tables and anchors without others of their label give no rows. Further
    columns are ignored, whatever their names.

    :return: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Every row meets every anchor in cells of `cell_rows` and `cell_anchors`; see `survivors` for what bounds rule out.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    col = lambda c, kind: F.col(quoted(c)).cast(kind)
    clean = vectors.select(col(id_col, "long").alias("id"), col(label_col, "long").alias("label"), col(vec_col, "array<long>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull()), F.lit(False)))
    rows = numbered(clean.groupBy("id", "label", "x").agg(F.max("asks").alias("asks")), scratch, "number")
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if size.n and size.low != size.high:
        raise ValueError(f"vectors of {size.low} to {size.high} entries")
    asking = numbered(rows.where("asks"), scratch, "part").withColumn("part", F.floor(F.col("part") / cell_anchors))
    n_anchors = asking.count()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not n_anchors:
        return vectors.sparkSession.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in names))
    ends = [-(2**62), 2**62]
    free = asking.withColumns({c: F.array(F.lit(x)) for c, x in zip(("low", "high"), ends, strict=True)})
    sized = (levels, cell_rows, cell_anchors)
    found = scratch.keep(_search(rows, free, size.n, n_anchors, positives, True, *sized))
    # the positives of an anchor, in order; each is a range of scores
    ranges = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "score"))).alias("p"))  # `positives` of each at most
    # a share of a score, rounded into the range; scores below 0 and missing positives have an empty one, from 2^62 to -2^62
    share = lambda p, of, up: F.when(p.score >= 0, F.call_function("div", of * p.score + F.lit(99 * up), F.lit(100)))
    bound = lambda of, up: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(share(F.get("p", k), of, up), F.lit(ends[up])))
    limited = asking.join(ranges, F.col("number") == F.col("anchor")).select("number", "id", "label", "x", "part", "p", bound(least, 1).alias("low"), bound(most, 0).alias("high"))
    limited = scratch.keep(limited)
    got = _search(rows, limited, size.n, n_anchors, negatives, False, *sized)
    told = limited.select(F.col("number").alias("own"), "p")
    pairs = got.join(told, F.col("anchor") == F.col("own")).withColumn("positive", F.get("p", F.col("range").cast("int")))
    return pairs.select("anchor_id", F.col("positive.row_id").alias("positive_id"), "rank", F.col("row_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def whole_steps(vectors: DataFrame, vec_col: str, scale: int, out_col: str) -> DataFrame:
    """Rows with a usable vector, and the array of floor(scale * entry)."""
    if fresh(vectors, out_col) != out_col:
        raise ValueError(f"vectors have a column {out_col} already")
    steps = F.transform(F.col(quoted(vec_col)).cast("array<double>"), lambda c: F.floor(scale * c).cast("long"))
    return vectors.where(usable(F.col(quoted(vec_col)))).withColumn(out_col, steps)


#: DuckDB's SQL for the registered query.
HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), a as (select * from v where vec_id % 100 = 0),
s as (select a.vec_id as anchor_id, v.vec_id as other, a.label = v.label as same, list_inner_product(a.x, v.x)::bigint as score from a join v on a.vec_id <> v.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::int as rank, other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
