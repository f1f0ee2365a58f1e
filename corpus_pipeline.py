"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import decontaminate, lineruns, minhash, mixing, toxicity
from cordon.llm.scratch import fresh, shared_dir
from cordon.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


CORE = ["doc_id", "text", "lang", "source", "n_chars"]
#: Weights of the sources that are left after the first stage, which has removed the toxic ones: the rest of mixing.TARGETS.
TARGETS = {c: mixing.TARGETS[c] for c in ("good", "plain")}
#: Lowest and highest rate of the last stage: every document stays in the mix, however far the sources are off their targets.
LEAST, MOST = 0.05, 4.0


def any_columns(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage over documents whose further columns may have any names (dots, clashes) and types: they bear plain names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in CORE else f"_extra{k}" for k, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*plain), sf_dir)
        return out.toDF(*docs.columns, *out.columns[len(plain) :])

    return run


@any_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic. Rows are judged one by one: repeated rows and
    ids, null ids, null, empty and very long texts stay or go by their text alone; a probability that ties with
    the threshold goes."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


@any_columns
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines of 30 words or more; n_chars follows the text. A text that
    loses all its words goes; null and empty texts stay. Rows of one id and text are one document."""
    ship(spark)
    return lineruns.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@any_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of smallest id.

    Rows that repeat an id and its text become one, the least by its other columns; rows of one id with
    different texts stay together or go together, as one document. Of rows with a null id, which are
    linked with nothing, one of each text stays. Null and empty texts are copies of nothing; very long
    ones are compared whole.
    """
    ship(spark)
    groups = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    gone = fresh(docs, "_id")
    left = docs.join(groups.withColumnRenamed("id", gone), F.col("doc_id") == F.col(gone), "left_anti")
    # the least row of each id and text by its other columns, written out (of any type); texts are told apart by a digest
    others = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias(fresh(docs, "_none"))))
    own = left.withColumn(mark := fresh(docs, "_text"), F.sha2(F.coalesce("text", F.lit("")), 256))
    first = own.groupBy("doc_id", F.col("text").isNull().alias("none"), mark).agg(F.min_by(F.struct(*(c for c in docs.columns if c != "doc_id")), others).alias("row"))
    return first.select(*("doc_id" if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns))


@any_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark phrase. Rows are judged one by one."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


@any_columns
def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate, from LEAST to MOST: how often a document is to be drawn for the sources to meet
    TARGETS (in proportion). Null, empty and very long texts have a rate too; repeated rows count as often as they
    stand, rows of equal posteriors have equal rates. `mix_miss` is the largest distance of a source's expected share
    from its target, the same for all rows."""
    name, good = fresh(docs, "_rate"), F.col("quality") == 1
    out = mixing.mix(docs, _table(spark, sf_dir, "labels"), out_col=name, conditions={"good": good, "plain": ~good}, targets=TARGETS, least=LEAST, most=MOST)
    added = [F.col(f"{name}.tokens").alias("mix_tokens"), F.round(f"{name}.rate", 6).alias("mix_rate"), F.round(f"{name}.miss", 6).alias("mix_miss")]
    return out.select(*docs.columns, *added)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("minhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", weigh)]

#: The stages fit and search; SQL doesn't express them. tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/cordon/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}-{name}")
    return docs
