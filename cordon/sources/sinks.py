"""Sinks that never overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_ledger(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Append records, partitioned by a bucket of their scope; there is no update or delete."""
    bucket = F.pmod(F.xxhash64("scope"), F.lit(buckets))
    df.withColumn("scope_bucket", bucket).repartition("scope_bucket").write.mode("append").partitionBy("scope_bucket").parquet(path)


def write_receipts(df: DataFrame, path: str) -> DataFrame:
    """Append receipts whose id is new; return those whose id has another content there, or in the batch (none is overwritten).

    An id that repeats in the batch with one content is written once; with several, none of them is.
    The conflicts are a table of their own under `path`_conflicts, so they pass by no driver. One writer at a time.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.limit(0).write.parquet(path)
    there = spark.read.schema(df.schema).parquet(path)
    old = there.select("receipt_id", F.col("content_sha256").alias("old"))
    twice = df.groupBy("receipt_id").agg(F.min("content_sha256").alias("lo"), F.max("content_sha256").alias("hi")).where("lo <> hi").select("receipt_id")
    clear = df.join(twice, "receipt_id", "left_anti").dropDuplicates(["receipt_id"])
    conflicts = clear.join(old, "receipt_id").where("old <> content_sha256").drop("old").unionByName(df.join(twice, "receipt_id", "left_semi"))
    to = f"{path}_conflicts/{uuid.uuid4().hex}"
    conflicts.select(*df.columns).write.parquet(to)
    clear.join(old, "receipt_id", "left_anti").select(*df.columns).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(to)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("errorifexists").json(path)
