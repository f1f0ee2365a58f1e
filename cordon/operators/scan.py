"""Running values within keys of any size: buckets of a hot key's rows run side by side, each adds what the buckets before it carry.

A window by key alone sends all rows of a key to one task. Here keys with more rows than a task should take are cut at
quantiles of their order column, so that a bucket is a contiguous stretch of its key. A scan is then a window by (key, bucket),
one row of totals for each bucket, a running value over those rows, and a join that adds it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 1_000_000
MAX_PARTS = 1_000  # buckets of one key
MAX_BOUNDS = 100_000  # buckets of all hot keys together, which bounds what is broadcast


@dataclass(frozen=True)
class Buckets:
    """Rows with the columns that part them: the key, and the bucket where a key is hot (null for keys that aren't)."""

    df: DataFrame
    key: str
    bucket: str | None

    @property
    def by(self) -> list[str]:
        return [self.key] if self.bucket is None else [self.key, self.bucket]

    def done(self) -> DataFrame:
        return self.df if self.bucket is None else self.df.drop(self.bucket)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, key: str, order: str, rows_per_task: int = ROWS_PER_TASK) -> Buckets:
    """df with a bucket for the rows of each key that has more than `rows_per_task`, in the order of `order` (a number or a time).

    Rows of an equal order value share a bucket, so a single moment isn't split; nulls are in the first one. Counts and quantiles are
    aggregated before the shuffle. The cuts (at most MAX_BOUNDS numbers: with more hot rows, buckets get larger) are held as
    plain values, so that a task that runs again cuts at the same places. Without a hot key, rows stay as they are.
    """
    n, bucket, cuts, own = (fresh(df, c) for c in ("_n", "_bucket", "_cuts", "_key"))
    counts = df.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > rows_per_task)
    total, largest = counts.agg(F.sum(n), F.max(n)).first()
    if not total:
        return Buckets(df, key, None)
    step = max(rows_per_task, -(-total // MAX_BOUNDS), -(-largest // MAX_PARTS))
    most = -(-largest // step)
    if most < 2:
        return Buckets(df, key, None)
    hot = F.broadcast(counts.where(F.col(n) > step).withColumnRenamed(key, own))
    parts = F.ceil(F.col(n) / step)
    by = F.unix_micros(order) if isinstance(df.schema[order].dataType, T.TimestampType) else F.col(order)
    quantiles = F.percentile_approx(by, [i / most for i in range(1, most)], 10 * most)
    per = df.select(key, order).join(hot, F.col(key).eqNullSafe(F.col(own))).groupBy(own, n).agg(quantiles.alias(cuts))
    picked = F.transform(F.sequence(F.lit(1), (parts - 1).cast("int")), lambda j: F.element_at(cuts, F.ceil(j * most / parts).cast("int")))
    per = per.select(own, F.array_distinct(picked).alias(cuts))
    held = df.sparkSession.createDataFrame(per.collect(), per.schema)
    out = df.join(F.broadcast(held), F.col(key).eqNullSafe(F.col(own)), "left")
    # how many of the rising cuts are at or below the row's value, by halves: there may be a thousand
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda found, s: F.when(F.try_element_at(F.col(cuts), found + s) <= by, found + s).otherwise(found))
    return Buckets(out.withColumn(bucket, F.when(F.col(cuts).isNotNull(), place)).drop(own, cuts), key, bucket)


def scan(b: Buckets, order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = False, peers: bool = True) -> Buckets:
    """Adds a running value for each name: ("sum" | "max" | "last", column) over the rows of the key before this one.

    `inclusive` takes the row itself in. `peers=False` leaves out all rows of an equal order value (one number as order).
    "last" is the latest value that isn't null; a sum of no rows is 0. order[0] is the column that the buckets were cut by.
    """
    w = Window.partitionBy(*b.by).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1) if peers else w.rangeBetween(Window.unboundedPreceding, -1)
    local = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, True)}
    out = b.df.withColumns({name: local[kind](c).over(w) for name, (kind, c) in values.items()})
    if b.bucket is not None:
        own, at = fresh(out, "_key"), fresh(out, "_at")
        latest = F.struct(*order)
        whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), latest))}
        before = Window.partitionBy(own).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        carried = {name: fresh(out, f"_c{i}") for i, name in enumerate(values)}
        totals = b.df.where(F.col(b.bucket).isNotNull()).groupBy(F.col(b.key).alias(own), F.col(b.bucket).alias(at)).agg(*(whole[kind](c).alias(carried[name]) for name, (kind, c) in values.items()))
        carry = totals.select(own, at, *(local[kind](F.col(carried[name])).over(before).alias(carried[name]) for name, (kind, _) in values.items()))
        out = out.join(F.broadcast(carry), F.col(b.key).eqNullSafe(F.col(own)) & (F.col(b.bucket) == F.col(at)), "left")
        add = {"sum": lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), "max": F.greatest, "last": F.coalesce}
        out = out.withColumns({name: add[kind](F.col(name), F.col(carried[name])) for name, (kind, _) in values.items()}).drop(own, at, *carried.values())
    zero = {name: F.coalesce(name, F.lit(0)) for name, (kind, _) in values.items() if kind == "sum"}
    return replace(b, df=out.withColumns(zero) if zero else out)


def segments(df: DataFrame, key: str, order: list[str], busy_until: Column, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, str | None]:
    """df with a column that numbers the stretches between reset points of each key; None where no key has more than `rows_per_task` rows.

    busy_until: the value of order[0] from which a row no longer matters to later ones (null: it never does). A row at which no
    row before it matters any more starts a stretch: an ordered fold meets an empty state there, so stretches can be folded apart.
    """
    b = cut(df, key, order[0], rows_per_task)
    if b.bucket is None:
        return df, None
    reach, start, number = fresh(df, "_reach"), fresh(df, "_start"), fresh(df, "_segment")
    b = scan(b, order, {reach: ("max", busy_until)})
    starts = F.coalesce(F.col(reach) <= F.col(order[0]), F.lit(True)).cast("long")
    b = scan(replace(b, df=b.df.withColumn(start, starts)), order, {number: ("sum", F.col(start))}, inclusive=True)
    return b.done().drop(reach, start), number


def segment_report(df: DataFrame, key: str, order: list[str], busy_until: Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """key, n_rows, n_segments and largest of each key with more than `rows_per_task` rows: `largest` is what one task must fold alone."""
    parted, number = segments(df, key, order, busy_until, rows_per_task)
    if number is None:
        number = fresh(df, "_segment")
        parted = df.where("false").withColumn(number, F.lit(1))
    per = parted.groupBy(key, number).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_segments"), F.max("n").alias("largest")).where(F.col("n_rows") > rows_per_task)
