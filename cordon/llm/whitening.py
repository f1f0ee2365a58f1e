"""Whitening of vectors with MLlib's BlockMatrix.

Centred rows are indexed into distributed blocks; the blocks' transpose times the blocks is the
scatter matrix, whose eigenvectors (of a matrix as wide as one vector) are found locally; the
blocks times the whitening matrix, a BlockMatrix too, are the whitened rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, numbered, quoted

#: Rows of one block.
BLOCK_ROWS = 1024
#: Blocks of one BlockMatrix. The driver holds the coordinates of a matrix's blocks while it multiplies; more blocks are more matrices.
SLAB_BLOCKS = 1 << 16


def usable(vec: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite), F.lit(False))


def _blocks(rows: DataFrame, n: int, width: int, block_rows: int, slab_blocks: int, scratch: Scratch) -> list[tuple[int, BlockMatrix]]:
    """Rows (index, v array<double>) as matrices of one column of blocks, each with the number of its first row.

    The blocks are a written table: the products read it again and again, and losing an executor repeats no step before it.
    """
    own = rows.groupBy(F.floor(F.col("index") / block_rows).alias("block")).agg(F.sort_array(F.collect_list(F.struct("index", "v"))).alias("rows"))
    table = scratch.keep(own.select("block", F.size("rows").alias("n"), F.flatten("rows.v").alias("values")))
    out, blocks = [], -(-n // block_rows)
    for low in range(0, blocks, slab_blocks):
        part = table.where((F.col("block") >= low) & (F.col("block") < low + slab_blocks))
        dense = part.rdd.map(lambda r, low=low: ((int(r.block - low), 0), DenseMatrix(r.n, width, r["values"], True)))
        out.append((low * block_rows, BlockMatrix(dense, block_rows, width, min(slab_blocks * block_rows, n - low * block_rows), width)))
    return out


def _scatter(m: BlockMatrix, parts: int) -> np.ndarray:
    """Transpose of m times m. The middle dimension, the rows, is split, so that no task gets all blocks of a product of one block."""
    java = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(java, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def _means(rows: DataFrame) -> np.ndarray:
    got = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).collect()
    return np.array([r.m for r in sorted(got, key=lambda r: r.j)])


def _centred(rows: DataFrame) -> DataFrame:
    return rows.select("index", F.zip_with("v", F.lit(_means(rows)), lambda x, m: x - m).alias("v"))


def whiten(vectors: DataFrame, vec_col: str = "embedding", components: int = 8, out_col: str = "_white", block_rows: int = BLOCK_ROWS, slab_blocks: int = SLAB_BLOCKS) -> DataFrame:
    """Whitened coordinates of every row on the first `components` principal components of all rows.

    Rows whose vector is null, empty or has a null or non-finite entry are left out; all others are
    fitted on, repeated ones as often as they stand. Vectors must be of one length (else ValueError).
    A component is a unit eigenvector of the covariance (divisor n), in falling order of its
    eigenvalue e; of equal eigenvalues any base may come, and either sign, the same for all rows.
    Components without variance (e below the rounding of the largest) are left out, so rows of one
    value have none. An empty table gives no rows. Other columns, null ids too, are carried along
    whatever their names; `out_col` must be a new name.

    :return: columns of `vectors` and the struct `out_col`: n (long), whitened (array, one number a
        component), explained (array, e over the trace), identity_error (largest absolute entry of the
        covariance of `whitened` minus the identity).
    """
    if fresh(vectors, out_col) != out_col:
        raise ValueError(f"vectors have a column {out_col} already")
    scratch, index = Scratch(vectors.sparkSession, "whitening"), fresh(vectors, "_index")
    vec = F.col(quoted(vec_col))
    rows = numbered(vectors.where(usable(vec)), scratch, index)
    size = rows.agg(F.count("*").alias("n"), F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("high")).first()
    n, width = size.n, size.high
    none = F.struct(F.lit(n).cast("long").alias("n"), *(F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")), F.lit(0.0).alias("identity_error"))
    columns = [F.col(quoted(c)) for c in vectors.columns]
    if not n:
        return rows.select(*columns, none.alias(out_col))
    if size.low != width:
        raise ValueError(f"vectors of {size.low} to {width} entries")
    centred = _centred(rows.select(F.col(index).alias("index"), vec.cast("array<double>").alias("v")))
    matrices = _blocks(centred, n, width, block_rows, slab_blocks, scratch)
    parts = max(1, min(-(-n // block_rows), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    values, axes = np.linalg.eigh(reduce(np.add, (_scatter(m, parts) for _, m in matrices)) / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > max(values[0], 0.0) * width * np.finfo(float).eps).sum()))
    if not k:
        return rows.select(*columns, none.alias(out_col))
    weights = vectors.sparkSession.createDataFrame([(j, w.tolist()) for j, w in enumerate(axes[:, :k] / np.sqrt(values[:k]))], "index long, v array<double>")
    ((_, by),) = _blocks(weights, width, k, width, slab_blocks, scratch)
    projected = []
    for low, m in matrices:
        java = m.multiply(by).toIndexedRowMatrix()._java_matrix_wrapper._java_model
        # the rows as MLlib gives them to Python, before they are made Python objects
        projected.append(callMLlibFunc("getIndexedRows", java).select((F.col("index") + low).alias("index"), vector_to_array("vector").alias("v")))
    white = scratch.keep(reduce(DataFrame.unionByName, projected))
    cover = reduce(np.add, (_scatter(m, parts) for _, m in _blocks(_centred(white), n, k, block_rows, slab_blocks, scratch))) / n
    told = F.struct(F.lit(n).cast("long").alias("n"), F.col("v").alias("whitened"), F.lit(values[:k] / values.sum()).alias("explained"), F.lit(float(np.abs(cover - np.eye(k)).max())).alias("identity_error"))
    own = white.select(F.col("index").alias(at := fresh(rows, "_at")), told.alias(out_col))
    return rows.join(own, F.col(index) == F.col(at)).select(*columns, out_col)
