"""Registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import licences, mixing, negatives, simhash
from .decontaminate import report
from .divergence import quality_rules
from .language import identify
from .lineruns import line_report
from .minhash import near_duplicates
from .oracle_quality import QUALITY
from .oracle_text import DECONTAMINATION, NEAR_DUPLICATES
from .resample import resample
from .substring import remove_repeats
from .toxicity import classify
from .whitening import usable, whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on two-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), ngram=2, percent=80)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and histogram divergence of every document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word benchmark phrases."""
    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document."""
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier-chain probabilities of every document."""
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document inside later copies of runs of 30 words or more."""
    return line_report(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 100 earlier ones."""
    return remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op10_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of every document and the Gumbel top-k choice."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on 8 components; entries are counted in steps of 1/1024 from -100,000."""
    vectors = _table(spark, sf_dir, "embeddings")
    steps = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(1024 * c).cast("long") + 100_000)
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", steps.alias("x"))
    sums = rows.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("j").collect()  # a row an entry of a vector
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  a square can pass the range of a long
    apart = F.zip_with("x", F.array(*(F.lit(r.s) for r in sums)).cast("array<bigint>"), lambda x, s: whole(x * F.lit(sums[0].n if sums else 0) - s))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d * d).cast("decimal(38,0)"))
    white = whiten(rows.withColumn("deviation", deviation.cast("long")), "x")
    each = white.select("vec_id", "deviation", "_white", F.posexplode("_white.whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "_white.n", "deviation", "whitened", F.col("_white.explained")[F.col("k")].alias("explained"), "_white.identity_error")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints differ in 3 bits at most."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each anchor (ids divisible by 100) and each of its five positives."""
    steps = negatives.whole_steps(_table(spark, sf_dir, "embeddings"), "embedding", 256, "x")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(steps.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_minhash, op2_quality_rules, op3_decontamination, op4_mixing, op5_toxicity, op6_licences, op7_language, op8_line_dedup, op9_suffix_dedup, op10_quality_resample, op11_whitening, op12_simhash, op13_hard_negatives]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": NEAR_DUPLICATES, "op2_quality_rules": QUALITY, "op3_decontamination": DECONTAMINATION, "op6_licences": licences.oracle(), "op13_hard_negatives": negatives.HARD_NEGATIVES}
