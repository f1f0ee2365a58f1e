"""Line dedup: maximal repeated runs of lines, from suffix order and common-prefix intervals.

Lines are symbols. Prefix doubling numbers, for each power of two, the classes of positions whose
next 2^k lines are equal: a class of 2^(k+1) lines is a pair of classes of 2^k, and pairs are
numbered in sorted order, so the numbers of level k order the suffixes by their first 2^k lines.
Doubling goes on until no two suffixes agree on so many lines; positions that are alone leave.

The tree of longest-common-prefix intervals is then walked from the top, halving the step. All
positions of an interval of n lines that share 2^k lines more move to an interval of n + 2^k
lines; its first position also stays behind and stands for all of them. At the end every
position knows the longest run that starts there and earlier too, and the run is maximal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, fresh
from .textkit import BLANK_SPLIT, SpanHash, flatten, slices, word_spans

LAST = (1 << 63) - 1
AT = ["id", "mark", "pos"]
PLACE = ["id", "pos", "mark"]


def _cut(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, line starts and ends, words of each line, and for each text the range of its lines."""
    data, offsets = flatten(texts)
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    words = np.searchsorted(word_spans(data, offsets, BLANK_SPLIT)[0], np.stack([start, end]))
    return data, start, end, words[1] - words[0], np.searchsorted(start, offsets)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line that has a word: its place among those of its text, a 124-bit hash and its number of words."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, start, end, words, at = _cut(part.column("text"))
            full = words > 0
            doc = np.repeat(np.arange(part.num_rows), np.diff(at))[full]
            to = np.concatenate([[0], np.cumsum(full)])[at]
            hashes = [SpanHash(data, salt)(start[full], end[full]).view(np.int64) for salt in (0, 5)]
            own = [part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "mark")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, np.arange(len(doc)) - to[doc], *hashes, words[full])], names=[*AT, "h1", "h2", "words"])


def _numbers(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Keys of more than one row, numbered in sorted order, with the first place of each."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    return scratch.keep(shared.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("number"), "first"))


def _levels(lines: DataFrame, min_words: int, scratch: Scratch) -> list[DataFrame]:
    """For each power of two: AT, r (class of the next 2^k lines), more (the position has a class of twice as
    many lines) and first (it is the first place of that class)."""
    level = lines.join(_numbers(lines, ["h1", "h2"], scratch), ["h1", "h2"]).select(*AT, F.col("number").alias("r"), "words")
    # a counted run lies inside a stretch of such lines that has as many words
    order = Window.partitionBy("id", "mark").orderBy("pos")
    level = level.withColumn("stretch", F.col("pos") - F.row_number().over(order))
    level = level.withColumn("all", F.sum("words").over(Window.partitionBy("id", "mark", "stretch"))).where(F.col("all") >= min_words).select(*AT, "r")
    levels, size = [], 1
    while True:
        within = order.rangeBetween(size, size)
        pairs = scratch.keep(level.withColumn("r2", F.max("r").over(within)))
        numbers = _numbers(pairs.where("r2 is not null"), ["r", "r2"], scratch)
        longer = pairs.where("r2 is not null").join(numbers, ["r", "r2"], "left").select(*AT, "r", "number", F.coalesce(F.col("first") == F.struct(*PLACE), F.lit(False)).alias("first"))
        alone = pairs.where("r2 is null").select(*AT, "r", F.lit(None).cast("long").alias("number"), F.lit(False).alias("first"))
        levels.append(scratch.keep(longer.unionByName(alone)))
        scratch.drop(pairs)
        level = levels[-1].where("number is not null").select(*AT, F.col("number").alias("r"))
        size *= 2
        if level.isEmpty():
            return levels


def repeated_runs(texts: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """id, mark, pos, length: for each position the longest run of lines from there that starts earlier too,
    unless the run of the position before holds it. Runs of all lengths in lines; some have fewer than `min_words` words.

    :param texts: id (long), mark (long, tells texts of equal id apart), text. Positions count
        the lines that have a word. Earlier: smaller (id, pos).
    """
    lines = scratch.keep(texts.mapInArrow(_lines, "id long, mark long, pos long, h1 long, h2 long, words long").dropDuplicates(AT))
    levels = _levels(lines, min_words, scratch)
    key = ["class", "length", "r"]
    moving, found = None, []
    for k in range(len(levels) - 1, -1, -1):
        top = levels[k].where("number is null or first").select(*AT, F.lit(None).cast(T.StructType([T.StructField(c, T.LongType()) for c in ("id", "pos", "mark")])).alias("class"), F.lit(0).cast("long").alias("length"), "r")
        rows = top
        if moving is not None:
            ahead = levels[k].select("id", "mark", F.col("pos").alias("next"), "r")
            rows = top.unionByName(moving.withColumn("next", F.col("pos") + F.col("length")).join(ahead, ["id", "mark", "next"], "left").select(*AT, *key))
        rows = scratch.keep(rows)
        live = rows.where("r is not null")
        own = F.coalesce("class", F.struct(*(F.lit(-1).cast("long").alias(c) for c in ("id", "pos", "mark"))))
        groups = live.groupBy(own.alias("own"), "length", "r").agg(F.min(F.struct(*PLACE)).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
        groups = scratch.keep(groups)
        moved = live.withColumn("own", own).join(groups, ["own", "length", "r"], "left").select(*AT, "class", "length", "to")
        moved = scratch.keep(moved.unionByName(rows.where("r is null").select(*AT, "class", "length", F.lit(None).cast(moved.schema["to"].dataType).alias("to"))))
        further = moved.where("to is not null").select(*AT, F.col("to").alias("class"), (F.col("length") + (1 << k)).alias("length"))
        stay = moved.where((F.col("to").isNull() | (F.col("to") == F.struct(*PLACE))) & (F.col("length") > 0)).select(*AT, "class", "length")
        scratch.drop(rows, groups)
        moving = further.unionByName(stay)
    later = (F.col("class.id") < F.col("id")) | ((F.col("class.id") == F.col("id")) & (F.col("class.pos") < F.col("pos")))
    longest = moving.where(later).groupBy(*AT).agg(F.max("length").alias("length"))
    before = F.lag(F.col("pos") + F.col("length")).over(Window.partitionBy("id", "mark").orderBy("pos"))
    return longest.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("pos") + F.col("length") > F.col("before")).select(*AT, "length")


def _delete(text: str, runs: str, names: list[str], min_words: int, report: bool):
    """Runs of `min_words` words or more go. Without the report, texts that have lost all their words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, start, end, words, at = _cut(part.column(text))
                raw, full = data.tobytes(), words > 0
                gone = np.zeros(len(start) + 1, np.int64)
                lists = part.column(runs)
                where = np.flatnonzero(full)
                to = np.concatenate([[0], np.cumsum(full)])[at]
                total = np.concatenate([[0], np.cumsum(words[full])])
                for k in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                    for x in lists[k].as_py():
                        a, b = to[k] + x["pos"], to[k] + x["pos"] + x["length"]
                        if total[b] - total[a] >= min_words:
                            gone[where[a]] += 1
                            gone[where[b - 1] + 1] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                new, counts, alive = [], [], []
                for k in range(part.num_rows):
                    a, b = at[k], at[k + 1]
                    hit = gone[a:b]
                    keep = raw[start[a] : end[b - 1]] if not hit.any() else b"\n".join(raw[start[x]:end[x]] for x in range(a, b) if not gone[x])
                    new.append(keep.decode() if part.column(text)[k].is_valid else None)
                    counts.append((int(b - a), int((hit & full[a:b]).sum()), int((hit & ~np.concatenate([[False], hit[:-1]])).sum())))
                    alive.append(not hit.any() or bool((full[a:b] & ~hit).any()))
                columns = {c: part.column(c) for c in part.schema.names} | {text: pa.array(new, pa.string())}
                out = [columns[c] for c in names]
                if report:
                    out += [pa.array(list(x), pa.int64()) for x in zip(*counts, strict=True)]
                    yield pa.RecordBatch.from_arrays(out, names=[*names, "n_lines", "n_removed_lines", "n_removed_runs"])
                else:
                    yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(alive))

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, str]:
    """All columns of `docs` and the runs of each text, and the name of their column."""
    scratch = Scratch(docs.sparkSession, "lineruns")
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(F.col(text_col).cast("string"))
    runs = repeated_runs(docs.select(key.alias("id"), mark.alias("mark"), F.col(text_col).cast("string").alias("text")), min_words, scratch)
    name, id_, mark_ = fresh(docs, "_runs"), fresh(docs, "_id"), fresh(docs, "_mark")
    lists = scratch.keep(runs.groupBy("id", "mark").agg(F.collect_list(F.struct("pos", "length")).alias(name)))
    scratch.only(lists)
    lists = lists.withColumnsRenamed({"id": id_, "mark": mark_}).hint("merge")
    return docs.withColumns({id_: key, mark_: mark}).join(lists, [id_, mark_], "left").drop(id_, mark_), name


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """Delete every line of a run of lines that stands earlier too and has `min_words` words or more.

    Earlier: in a document of smaller id, or earlier in the same one; the first copy stays. Lines
    are what \\n separates and must be equal byte for byte (by a hash of 124 bits); lines without a word are skipped when
    runs are matched, and deleted where they lie inside a deleted run. Runs may overlap. Null and empty texts have none
    and stay; rows that repeat an id and text are one document, and stay or change together; a
    null id counts as larger than all others. Texts and lines of any length are taken whole; an
    empty table gives no rows. A text that loses all its words is dropped.

    :return: the other rows of `docs`, with the text changed and all other columns as they were, whatever their names.

    What is shuffled is a row for each line, then only for lines that stand twice in stretches of
    `min_words` words; counts and first places are combined in the tasks, so a line of a third of
    all documents is not gathered in one.
    """
    joined, runs = _joined(docs, id_col, text_col, min_words)
    return joined.mapInArrow(_delete(text_col, runs, docs.columns, min_words, False), docs.schema)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """One row per row of `docs`: id, n_lines, n_removed_lines (with a word), n_removed_runs, kept_sha256 of the remaining lines."""
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("own_text"))
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed_lines", "n_removed_runs"))])
    joined, runs = _joined(own, "own_id", "own_text", min_words)
    out = joined.mapInArrow(_delete("own_text", runs, own.columns, min_words, True), schema)
    return out.select(F.col("own_id").alias(id_col), "n_lines", "n_removed_lines", "n_removed_runs", F.sha2(F.coalesce("own_text", F.lit("")), 256).alias("kept_sha256"))
