"""Governed releases over warehouse tables: aggregates that show only groups of k subjects or more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select(df: DataFrame, columns: list, predicate: Column | str | None = None) -> DataFrame:
    return (df if predicate is None else df.where(predicate)).select(*columns)


def distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()


def top_k(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def agg_by(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def subjects_by(df: DataFrame, keys: list[str], subject: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(subject).alias("subject_count"))


def release_min_group(df: DataFrame, keys: list[str], aggs: list[Column], subject: str, k: int = 20) -> DataFrame:
    """The aggregate with subject_count, without groups of fewer than k distinct subjects."""
    return df.groupBy(*keys).agg(*aggs, F.count_distinct(subject).alias("subject_count")).where(F.col("subject_count") >= k)


def strengthen(aggregate: DataFrame, own: Column | None, own_k: int | None, k: int = 20) -> DataFrame:
    """Rows of an aggregate with subject_count under the larger of two thresholds, other conditions kept."""
    out = aggregate.where(F.col("subject_count") >= max(k, own_k or 0))
    return out if own is None else out.where(own)


def check_groups(result: DataFrame, k: int = 20) -> DataFrame:
    """n_groups, smallest, passed: the result isn't empty and its smallest group has k subjects."""
    out = result.agg(F.count("*").alias("n_groups"), F.min("subject_count").alias("smallest"))
    return out.withColumn("passed", (F.col("n_groups") > 0) & F.coalesce(F.col("smallest") >= k, F.lit(False)))


def check_groups_by(result: DataFrame, key: str, k: int = 20) -> DataFrame:
    """key, passed: `check_groups` for the release of each key at once. A key without groups has no row."""
    return result.groupBy(key).agg(F.coalesce(F.min("subject_count") >= k, F.lit(False)).alias("passed"))


def qi_profile(df: DataFrame, qi_sets: dict[str, list[str]], subject: str, k: int = 20) -> DataFrame:
    """For each set of quasi-identifiers: n_groups, smallest, largest, n_below_k. One pass with grouping sets."""
    columns = sorted({c for s in qi_sets.values() for c in s})
    grouped = df.groupingSets([[F.col(c) for c in s] for s in qi_sets.values()], *columns).agg(F.grouping_id().alias("gid"), F.count_distinct(subject).alias("n"))
    gid = lambda s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
    name = F.coalesce(*(F.when(F.col("gid") == gid(s), F.lit(n)) for n, s in qi_sets.items()))
    return grouped.groupBy(name.alias("qi_set")).agg(F.count("*").alias("n_groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count_if(F.col("n") < k).alias("n_below_k"))


def suppressed(df: DataFrame, keys: list[str], subject: str, k: int = 20) -> DataFrame:
    """Groups, subject memberships and rows that the threshold releases and withholds."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(subject).alias("s"))
    low = F.col("s") < k
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return g.agg(F.count_if(~low).alias("groups_released"), F.count_if(low).alias("groups_withheld"), total("s", ~low).alias("subjects_released"), total("s", low).alias("subjects_withheld"), total("n", ~low).alias("rows_released"), total("n", low).alias("rows_withheld"))


def preview(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in order, and truncated: there is another row."""
    got = df.orderBy(*order).limit(n + 1)
    number = got.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return number.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > n).where(F.col("_n") <= n).drop("_n")


def cell_budget(df: DataFrame, max_bytes: int = 65_536) -> DataFrame:
    """Adds largest_cell (bytes of the largest string or binary value of the row) and cell_ok."""
    cells = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    largest = F.greatest(*cells) if len(cells) > 1 else (cells[0] if cells else F.lit(0).cast("long"))
    return df.withColumn("largest_cell", largest).withColumn("cell_ok", F.col("largest_cell") <= max_bytes)


def payload_budget(df: DataFrame, keys: list[str], order: list, size: Column, max_bytes: int = 262_144) -> DataFrame:
    """Rows of each result (keys) as long as their running size stays within the budget."""
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_bytes", F.sum(size).over(within)).where(F.col("running_bytes") <= max_bytes)


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals to strings, times to ISO text, bytes to hex; by the schema."""
    def safe(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("string")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(f.dataType, T.BinaryType):
            return F.lower(F.hex(c))
        return c

    return df.select(*(safe(f).alias(f.name) for f in df.schema))


def drop_by_category(df: DataFrame, categories: dict[str, str], category: str) -> DataFrame:
    return df.drop(*(c for c, own in categories.items() if own == category))


def coarsen(df: DataFrame, column: str, unit: str) -> DataFrame:
    return df.withColumn(column, F.date_trunc(unit, column))


def aggregate_sensitive(df: DataFrame, keys: list[str], column: str, distinct: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_distinct(column) if distinct else F.count(column)).alias(f"{column}_count"))


def release_conditional(df: DataFrame, keys: list[str], branch: Column, subject: str, k: int = 20) -> DataFrame:
    """Rows on a branch by group, shown only where the branch itself has k distinct subjects."""
    return df.groupBy(*keys).agg(F.count_if(branch).alias("branch_rows"), F.count_distinct(F.when(branch, F.col(subject))).alias("branch_subjects")).where(F.col("branch_subjects") >= k)
