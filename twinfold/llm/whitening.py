"""Whitening of vectors by distributed block matrices.

Centred rows get gapless indices and become the blocks of a BlockMatrix. Its transpose times itself is
the scatter matrix, a single block of dimension by dimension, whose eigenvectors are found on the
driver; a second product with the whitening matrix projects the rows.

Blocks are made of rows by a grouping of their own and written as a table that the matrix is read
from: the matrix class would move every entry by itself, and would do so again for each product.

A block matrix keeps the numbers of its blocks on the driver while it plans a product. Rows are
therefore taken in slabs of at most ``SLAB_BLOCKS`` blocks; scatter matrices of slabs add up, and
rows are projected slab by slab.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinfold.operators.scratch import materialize, scratch_root

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000  # Fixed values: the grid on which entries become whole numbers
LARGEST = float(1 << 52)  # whole numbers beyond are not exact as doubles; entries stop there
BLOCK_ROWS = 1024
SLAB_BLOCKS = 20_000
BLOCKS_PER_SPLIT = 8  # blocks of the long dimension that one task multiplies
RANK_LIMIT = 1e-12  # an eigenvalue below this share of the largest is no component


@dataclass
class Whitening:
    """What was fitted: rows, sums per dimension, eigenvalues and eigenvectors (columns), falling; and the
    largest absolute entry of the covariance of the whitened rows minus the identity."""

    rows: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0


def grid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(64 c) + 1000000 of each entry c, for the vectors that hold no null and no
    non-finite entry."""
    entry = F.col(vector_col)
    fine = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))
    whole = F.transform(entry, lambda c: F.floor(scaled(c)) + SHIFT)
    return vectors.where(entry.isNotNull()).where(fine).select(F.col(id_col).alias("id"), whole.alias("x"))


def _indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with gapless ``index`` from 0; written before, as the layout that gives the indices must
    not change under them."""
    placed = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "grid")
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select(  # a row per partition
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    index = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn("index", index).drop("_part", "_row", "_start")


def _column_sums(rows: DataFrame, column: str, kind: str) -> list:
    entries = rows.select(F.posexplode(column).alias("place", "v"))
    sums = entries.groupBy("place").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return [r["v"] for r in sums.orderBy("place").collect()]  # a row per dimension


PLACE = "_1 struct<_1: bigint, _2: bigint>"
PLAIN = f"{PLACE}, _2 struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, values: array<double>, isTransposed: boolean>"


def _path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _blocks(rows: DataFrame, values: Column, columns: int, block_rows: int) -> BlockMatrix:
    """The matrix whose row ``index`` is ``values``. Matrices are stored as plain structures; read as such
    they are matrices to the JVM, so no entry passes through Python."""
    spark = rows.sparkSession
    numbered = rows.select(F.floor(F.col("index") / block_rows).alias("block"), F.struct("index", values.alias("v")).alias("row"))
    grouped = numbered.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # block_rows rows at most
    matrix = F.struct(
        F.lit(1).cast("tinyint").alias("type"), F.size("rows").alias("numRows"), F.lit(columns).alias("numCols"),
        F.lit(None).cast("array<int>").alias("colPtrs"), F.lit(None).cast("array<int>").alias("rowIndices"),
        F.flatten(F.transform("rows", lambda r: r["v"])).alias("values"), F.lit(True).alias("isTransposed"))
    path = _path(spark, "blocks")
    grouped.select(F.struct(F.col("block").alias("_1"), F.lit(0).cast("bigint").alias("_2")).alias("_1"), matrix.alias("_2")).write.parquet(path)
    table = spark.read.schema(StructType.fromDDL(PLACE).add("_2", MatrixUDT())).parquet(path)
    count = rows.agg(F.max("index")).first()[0] + 1
    java = callMLlibFunc("createBlockMatrix", table, block_rows, columns, count, columns)
    return BlockMatrix(java, block_rows, columns)


def _rows(matrix: BlockMatrix, path: str, first: int) -> None:
    """Append the rows of a matrix, numbered from ``first``, to a table (index, whitened) at ``path``."""
    blocks = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model)
    spark, stored = blocks.sparkSession, _path(blocks.sparkSession, "turned")
    blocks.toDF("_1", "_2").write.parquet(stored)
    plain = spark.read.schema(PLAIN).parquet(stored)
    m, n, v = F.col("_2.numRows"), F.col("_2.numCols"), F.col("_2.values")
    # entry (i, j) stands at j * rows + i, or at i * columns + j where the matrix is transposed
    row = lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get(
        v, F.when(F.col("_2.isTransposed"), i * n + j).otherwise(j * m + i)))
    every = F.transform(F.sequence(F.lit(0), m - 1), row)
    plain.select((F.col("_1._1") * matrix.rowsPerBlock + first).alias("base"), F.posexplode(every).alias("at", "whitened")).select(
        (F.col("base") + F.col("at")).alias("index"), "whitened").write.mode("append").parquet(path)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, its middle dimension cut into ``splits``: without, all blocks that meet in a block
    of the result would meet in one task. Python's ``multiply`` has no such argument, the JVM's has."""
    java = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times itself; of the size of the dimensions, whatever the rows."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_PER_SPLIT))
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _centred(column: str, mean: np.ndarray) -> Column:
    return F.zip_with(column, F.lit([float(m) for m in mean]), lambda x, m: x - m)


def _slabs(rows: DataFrame, slab_rows: int) -> list[tuple[int, DataFrame]]:
    """(first index, rows numbered from 0) of each slab."""
    last = rows.agg(F.max("index")).first()[0]
    found = []
    for first in range(0, last + 1, slab_rows):
        own = rows.where((F.col("index") >= first) & (F.col("index") < first + slab_rows))
        found.append((first, own.withColumn("index", F.col("index") - first)))
    return found


def _deviation(fitted: Whitening, lowest: int, highest: int) -> Column:
    """The exact sum of (n x - S)^2: in 64 bits where it is sure to fit, else in decimals; null where
    it exceeds 64 bits."""
    n, sums = fitted.rows, fitted.sums
    reach = max((max(abs(n * lowest - s), abs(n * highest - s)) for s in sums), default=0)
    if reach**2 * max(len(sums), 1) < 1 << 63 and n * max(abs(lowest), abs(highest)) < 1 << 63:
        squares = F.zip_with("x", F.lit(sums), lambda x, s: (x * n - s) * (x * n - s))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda a, v: a + v)
    wide = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    apart = F.zip_with("x", wide, lambda x, s: (x.cast("decimal(19,0)") * F.lit(str(n)).cast("decimal(18,0)") - s).cast("decimal(19,0)"))
    total = F.aggregate(apart, F.lit("0").cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))
    return total.try_cast("bigint")


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS,
           block_rows: int = BLOCK_ROWS, slab_blocks: int = SLAB_BLOCKS) -> tuple[DataFrame, Whitening | None]:
    """Rows (id, deviation, whitened) with the coordinates on the first ``components`` components as
    an array, and the fit; no rows and no fit where nothing varies.

    Entries c become floor(64 c) + 1000000, 64 c no further from 0 than 2^52. Vectors that are null or hold null or non-finite entries
    are left out; so are those of another length than most have (the longer length among equals), as
    they fit in no matrix. Repeated rows, ids and null ids stay rows of their own. Directions without
    variance (an eigenvalue under ``RANK_LIMIT`` of the largest) are no components, so a table of one
    row or of equal rows gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    grid = grid_vectors(vectors, id_col, vector_col)
    kind = grid.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"id {kind}, deviation bigint, whitened array<double>")
    usual = grid.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None or not usual["n"]:
        return empty, None
    slab_rows = block_rows * slab_blocks
    rows = _indexed(grid.where(F.size("x") == usual["n"]))
    n, lowest, highest = rows.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    fits = n * max(abs(lowest), abs(highest)) < 1 << 63
    sums = [int(s) for s in _column_sums(rows, "x", "bigint" if fits else "decimal(20,0)")]
    mean = np.array([s / n for s in sums])
    slabs = [(first, _blocks(own, _centred("x", mean), len(mean), block_rows)) for first, own in _slabs(rows, slab_rows)]
    covariance = sum(_scatter(matrix) for _, matrix in slabs) / n
    values, eigenvectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, eigenvectors = values[::-1], eigenvectors[:, ::-1]
    kept = min(components, int(np.count_nonzero(values > max(values[0], 0.0) * RANK_LIMIT)))
    if not kept:
        return empty, None
    fitted = Whitening(n, sums, float(np.trace(covariance)), values[:kept], eigenvectors[:, :kept])

    turning = fitted.vectors / np.sqrt(fitted.values)
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(*turning.shape, turning.ravel(order="F")))], 1)
    whitening = BlockMatrix(local, len(mean), kept, len(mean), kept)
    path = _path(spark, "projected")
    for first, matrix in slabs:
        _rows(_product(matrix, whitening, 1), path, first)
    found = spark.read.schema("index bigint, whitened array<double>").parquet(path)
    fitted.identity_error = _identity_error(found, n, kept, block_rows, slab_rows)
    described = rows.select("index", "id", _deviation(fitted, lowest, highest).alias("deviation"))
    return described.join(found, "index").select("id", "deviation", "whitened"), fitted


def _identity_error(found: DataFrame, rows: int, columns: int, block_rows: int, slab_rows: int) -> float:
    """Of the covariance of ``whitened``, centred before multiplying, in the same way as that of the input."""
    mean = np.array(_column_sums(found, "whitened", "double")) / rows
    scatter = sum(_scatter(_blocks(own, _centred("whitened", mean), columns, block_rows)) for _, own in _slabs(found, slab_rows))
    return float(np.abs(scatter / rows - np.eye(columns)).max())
