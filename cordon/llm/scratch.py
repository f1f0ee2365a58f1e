"""Tables written to the shared folder to cut lineage between rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local one is made, for a local master only: executors of a cluster wouldn't share it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cordon-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """A folder of Parquet tables below the shared folder, deleted when the application ends.

    A table that has been written survives lost executors; nothing is recomputed from the
    steps before it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/cordon/{label}-{uuid.uuid4().hex}"
        self._n, self._kept = 0, []
        path = self._hadoop(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table."""
        self._n += 1
        to = f"{self.path}/{self._n}"
        df.write.option("compression", "zstd").parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._cordon_path = to
        self._kept.append(out)
        return out

    def only(self, *tables: DataFrame) -> None:
        """Delete every table but these, once no lazy step reads the others."""
        self.drop(*(x for x in self._kept if not any(x is t for t in tables)))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            path = self._hadoop(df._cordon_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._kept = [x for x in self._kept if not any(x is t for t in tables)]


def quoted(name: str) -> str:
    """A column name as F.col takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame, scratch: Scratch, index: str) -> DataFrame:
    """df, written, with a column `index` (a new name) that counts its rows from 0 without gaps.

    Rows are numbered within the tasks that write them; the offsets (a row for each of those tasks) are broadcast.
    """
    kept = scratch.keep(df.withColumn(index, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(index), 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_part").alias(p := fresh(kept, "_part")), F.coalesce(before, F.lit(0)).alias(o := fresh(kept, "_offset")))
    return kept.join(F.broadcast(offsets), part == F.col(p)).withColumn(index, F.col(o) + F.col(index).bitwiseAND((1 << 33) - 1)).drop(p, o)
