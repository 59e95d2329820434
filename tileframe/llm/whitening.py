"""Whitening of embeddings by distributed block matrices.

Vectors are made whole numbers first, so that equal ones are found and sums are exact. The
centred distinct vectors are the rows of a BlockMatrix; its transpose times itself is the
scatter, whose eigenvectors are worked out on the driver (a matrix of the vectors' length, whatever
their number); the rows times the whitening matrix are their components.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, free, written
from .prefix import dense

#: Rows and columns of a block; columns of vectors that are whitened at most.
ROWS, COLUMNS = 4096, 1024
#: Share of the largest variance below which a component counts as without any.
LEAST = 1e-12


def whole_numbers(rows: DataFrame, vector_col: str, scale: int = 256) -> DataFrame:
    """``rows`` with column x, array of longs: each entry times ``scale``, rounded down.

    Rows whose vector is null, empty or has null or non-finite entries are left out, and so are those of another
    length than most rows have (of several such lengths the greatest).
    """
    entry = F.col(vector_col).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    # + 0 makes the negative zero a plain one before it becomes a long
    x = F.transform(entry, lambda c: (F.floor(c * scale) + F.lit(0)).cast("long"))
    return rows.where(F.col(vector_col).isNotNull() & F.forall(entry, finite) & (F.size(vector_col) > 0)).withColumn("x", x)


def _sums(fits: DataFrame) -> np.ndarray:
    """Exact sums of column x by dimension: as many numbers as a vector has."""
    found = fits.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()
    return np.array([r.s for r in found], dtype=object)


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """A matrix of ``n`` rows (index, vector: array of ``d`` doubles) in blocks; one row of blocks has all columns up to COLUMNS."""
    from pyspark.ml.functions import array_to_vector

    told = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(told, n, d).toBlockMatrix(min(ROWS, max(n, 1)), min(d, COLUMNS))


def indexed_rows(matrix: BlockMatrix) -> DataFrame:
    """(index, vector) of a block matrix, vectors as arrays."""
    from pyspark.mllib.common import callMLlibFunc

    told = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(told, "vector").select("index", vector_to_array("vector").alias("vector"))


def gram(matrix: BlockMatrix) -> np.ndarray:
    """The transpose of a block matrix times itself: a matrix of the rows' length, the only thing collected.

    Rows of blocks are multiplied in as many groups as there are, and their products summed up; in one group, which is all
    that the method for Python knows, they would meet in one task.
    """
    left = matrix.transpose()
    java = left._java_matrix_wrapper._java_model.multiply(matrix._java_matrix_wrapper._java_model, max(1, int(matrix.numRowBlocks)))
    return np.asarray(BlockMatrix(java, left.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray())


def local_blocks(sc, values: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A small local matrix as a block matrix of one column of blocks."""
    starts = range(0, values.shape[0], rows_per_block)
    parts = [((i, 0), DenseMatrix(*values[a : a + rows_per_block].shape, values[a : a + rows_per_block].ravel(order="F"))) for i, a in enumerate(starts)]
    return BlockMatrix(sc.parallelize(parts, 1), rows_per_block, values.shape[1], *values.shape)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int | None = None) -> DataFrame:
    """(id, x, n, deviation, whitened, variances, trace, identity_error) for each row of ``rows`` with a vector of finite entries.

    ``n`` distinct vectors of whole numbers x (``whole_numbers``) are what means and covariance are
    taken of, so copies count once. ``whitened`` are the first ``components`` (None: all that have a variance),
    by falling variance; components of no variance (below LEAST of the largest) don't exist, so
    equal vectors only have none. ``deviation`` is the exact sum of squares of n * x less the sums by dimension,
    an error where it exceeds a long. ``identity_error`` is the greatest entry of
    the whitened rows' covariance less the identity. Rows with equal vectors get equal results,
    null ids and repeated rows are kept, an empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    checkpoint_dir(spark)
    own = written(whole_numbers(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v").select("id", "x"))
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if lengths is None:
        return own.selectExpr("id", "x", "0L as n", "0L as deviation", "array(0D) as whitened", "array(0D) as variances", "0D as trace", "0D as identity_error").where("false")
    d = lengths.d
    own = own.where(F.size("x") == d)
    fits = written(dense(own.select("x").distinct(), "index"))
    n, sums = fits.count(), _sums(fits)
    mean = F.array(*[F.lit(int(s) / n) for s in sums])
    centred = fits.select("index", F.zip_with("x", mean, lambda x, m: x - m).alias("vector"))
    matrix = block_matrix(centred, n, d)
    covariance = gram(matrix) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    k = int((values > LEAST * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    k = k if components is None else min(k, components)
    total = F.array(*[F.lit(int(s)) for s in sums])
    square = lambda x, s: (n * x - s) * (n * x - s)
    deviation = F.aggregate(F.zip_with("x", total, square), F.lit(0).cast("long"), lambda a, b: a + b)
    if not k:
        nothing = fits.select("x", F.array().cast("array<double>").alias("whitened"))
        error = 0.0
    else:
        by = local_blocks(sc, vectors[:, :k] / np.sqrt(values[:k]), min(d, COLUMNS))
        projected = matrix.multiply(by)
        error = float(np.abs(gram(projected) / n - np.eye(k)).max())
        found = written(indexed_rows(projected))
        nothing = fits.join(found.withColumnRenamed("vector", "whitened"), "index").select("x", "whitened")
    done = own.join(nothing.withColumn("deviation", deviation), "x")
    return done.select(
        "id", "x", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(float(v)) for v in values[:k]]).cast("array<double>").alias("variances"),
        F.lit(float(np.trace(covariance))).alias("trace"), F.lit(error).alias("identity_error"),
    )
