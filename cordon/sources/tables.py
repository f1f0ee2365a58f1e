"""Scans and generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("datasets", T.MapType(T.StringType(), T.StructType([
        T.StructField("urn", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("domain", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StructType([
            T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
            T.StructField("glossary_terms", T.ArrayType(T.StringType())),
        ]))),
    ]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; Catalyst pushes filters and columns into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV with a fixed schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON catalog as one row a field: dataset, field, category, tags, glossary_terms. Without multi_line, each line is a document."""
    raw = spark.read.schema(CATALOG_SCHEMA).option("multiLine", multi_line).json(path)
    per_set = raw.select("version", F.explode("datasets").alias("dataset", "d"))
    return per_set.select("version", "dataset", "d.urn", F.explode("d.fields").alias("field", "f")).select("version", "dataset", "urn", "field", "f.category", "f.tags", "f.glossary_terms")


def gen_warehouse(spark: SparkSession, n: int, seed: int = 0) -> dict[str, DataFrame]:
    """A customer warehouse of n subjects: region by index mod 3, area by (index div 3) mod 4, three orders each."""
    i = spark.range(n).withColumnRenamed("id", "i")
    key = F.format_string("C%05d", "i")
    region = F.element_at(F.array(*map(F.lit, ("north", "south", "west"))), (F.col("i") % 3 + 1).cast("int"))
    area = F.concat_ws("-", region, F.expr("cast((i div 3) % 4 as string)"))
    noise = lambda k: F.pmod(F.xxhash64("i", F.lit(seed), F.lit(k)), F.lit(10_000)) / 10_000
    customers = i.select(key.alias("customer_id"), F.element_at(F.array(*map(F.lit, ("18-29", "30-44", "45-64", "65+"))), (F.col("i") % 4 + 1).cast("int")).alias("age_band"), area.alias("precise_area"), region.alias("coarse_region"))
    orders = i.select("i", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        F.format_string("O%05d-%d", "i", "k").alias("order_id"), key.alias("customer_id"), F.round(20 + 180 * F.pmod(F.xxhash64("i", "k", F.lit(seed)), F.lit(10_000)) / 10_000, 2).cast("decimal(12,2)").alias("purchase_amount"),
        F.element_at(F.array(*map(F.lit, ("books", "garden", "toys"))), ((F.col("i") + F.col("k")) % 3 + 1).cast("int")).alias("category"), F.timestamp_seconds(1_704_067_200 + F.col("i") * 3600 + F.col("k") * 86_400).alias("ordered_at"))
    case = F.when(F.col("i") % 11 == 0, "privacy").when(F.col("i") % 17 == 0, "legal").when(F.col("i") % 5 == 0, "medical").otherwise("billing")
    cases = i.select(F.format_string("S%05d", "i").alias("case_id"), key.alias("customer_id"), case.alias("case_category"), F.when(case == "billing", "low").otherwise("high").alias("sensitivity_level"))
    activity = i.select(key.alias("customer_id"), area.alias("precise_area"), (1 + F.floor(noise(1) * 50)).cast("int").alias("activity_count"))
    scores = i.select(key.alias("customer_id"), F.round(noise(2), 4).alias("churn_score"), F.timestamp_seconds(F.lit(1_706_745_600)).alias("model_timestamp"))
    return {"customers": customers, "orders": orders, "support_cases": cases, "location_activity": activity, "retention_scores": scores}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()])


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-free digest of all rows; equal for equal multisets of rows up to pairs that cancel, which n_rows and the sum tell apart."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    return df.select(part.alias("p")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("p"), F.lit(0)).alias("xor_digest"), F.coalesce(F.sum("p"), F.lit(0)).alias("sum_digest"))


def audit_objects(spark: SparkSession, glob: str, catalog: DataFrame) -> DataFrame:
    """Files against a catalog (path, size, sha256): status ok, missing, unexpected or changed."""
    files = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_sha256"))
    both = catalog.join(files, "path", "full_outer")
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("size") != F.col("found_size")) | (F.col("sha256") != F.col("found_sha256")), "changed").otherwise("ok")
    return both.select("path", status.alias("status"))
