"""Whitening of vectors on distributed block matrices.

The rows of integers are numbered, centred and dealt into the blocks of an MLlib ``BlockMatrix``.
Its transpose times itself is the scatter matrix, of which the driver takes the eigenvectors: it
is as wide as a vector, however many rows there are. The blocks times the whitening matrix are
the answers. Sums that have to be exact are decimals, the rest is in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opsframe.llm.knn_join import quantized
from opsframe.session import staged

#: Numbers in a block, columns of a block at most, and blocks that are multiplied in one task.
BLOCK_NUMBERS = 1 << 18
BLOCK_COLUMNS = 1 << 10
BLOCKS_PER_TASK = 16

_EXACT = "decimal(38,0)"
_ROW_BITS = 33
#: Entries stay within this, so that the offset can be added.
_LARGEST = 1 << 62


def whitened_rows(
    df: DataFrame,
    components: int = 8,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    offset: int = 100_000,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for each row and each
    of the first ``components`` principal components.

    Entries become ``floor(scale * entry) + offset``; of n such rows with sums S, ``deviation`` is
    the exact sum of ``(n * x - S)^2`` over the dimensions, ``whitened`` the centred row on the unit
    eigenvector over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace,
    and ``identity_error`` the largest absolute entry of the whitened rows' covariance minus the
    identity. An eigenvector's largest entry is positive, the first one of equals.

    Rows with a null vector, or with a null or non-finite entry, take no part. Shorter vectors go on
    in zeros, empty ones are all zeros. Rows with a null id, and rows that repeat, count each. There
    are as many components as dimensions at most; those without variance (below rounding) are left
    out, so that equal rows, one row, or none give no rows. A deviation that no long can hold is
    null. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = _numbered(
        df.select(F.col(id_col).alias("id"), quantized(F.col(vec_col), scale).alias("x")).where(
            "x IS NOT NULL"
        )
    )
    empty = (
        f"`{id_col}` {dict(df.dtypes)[id_col]}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = shape["n"], shape["width"]
    if not n or not width:
        return spark.createDataFrame([], empty)
    rest = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    rows = rows.withColumn("x", F.transform(F.concat("x", rest), lambda v: _clipped(v) + offset))
    # One column per dimension would make the plan as wide: the sums go by place in the vector.
    sums = (
        rows.select(F.posexplode("x").alias("dimension", "entry"))
        .groupBy("dimension")
        .agg(F.sum(F.col("entry").cast("decimal(28,0)")).cast(_EXACT).alias("total"))
        .orderBy("dimension")
        .collect()
    )
    totals = [int(row["total"]) for row in sums]
    centred = F.transform("x", lambda v, i: _centred(v, i, n, totals))
    scatter = _scatter(_blocks(rows.select("index", centred.alias("vector")), n, width))
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(scatter)) / n
    held = int((values[: min(components, width)] > width * np.finfo(float).eps * max(trace, 0)).sum())
    if not held:
        return spark.createDataFrame([], empty)
    vectors = vectors[:, :held] * np.sign(
        vectors[np.abs(vectors[:, :held]).argmax(axis=0), np.arange(held)]
    )
    matrix = vectors / np.sqrt(values[:held])

    projected = staged(
        _projected(
            spark, _blocks(rows.select("index", centred.alias("vector")), n, width), matrix
        ),
        "whitened",
    )
    error = _identity_error(projected, n, held)
    share = F.array(*[F.lit(float(v) / trace) for v in values[:held]])
    return (
        rows.select("index", "id", _deviation(n, totals).alias("deviation"))
        .join(projected, "index")
        .select("id", "deviation", F.posexplode("vector").alias("place", "whitened"))
        .select(
            F.col("id").alias(id_col),
            (F.col("place") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(share, F.col("place")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def _clipped(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(_LARGEST)), F.lit(-_LARGEST))


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``index``, from 0 without gaps: a row's place in its part of the written table, after
    the sizes of the parts before. What meets in one place is one count per part."""
    tag = F.monotonically_increasing_id()
    written = staged(
        df.withColumn("tag", tag).withColumn("part", F.shiftright("tag", _ROW_BITS)), "rows"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        written.groupBy("part")
        .agg(F.count(F.lit(1)).alias("held"), F.min("tag").alias("first"))
        .withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first"))
        .select("part", "start")
    )
    index = (F.col("tag") + F.col("start")).alias("index")
    return written.join(starts, "part").select(index, *df.columns)


def _centred(value: Column, place: Column, n: int, totals: list[int]) -> Column:
    """``x - S/n``; whole means are taken off as whole numbers, so that nothing is lost."""
    whole = F.array(*[F.lit(t // n) for t in totals])
    rest = F.array(*[F.lit((t % n) / n) for t in totals])
    return (value - F.get(whole, place)).cast("double") - F.get(rest, place)


def _deviation(n: int, totals: list[int]) -> Column:
    """The exact sum of ``(n * x - S)^2`` over the dimensions."""
    sums = F.array(*[F.lit(str(t)).cast(_EXACT) for t in totals])
    off = F.transform(
        "x",
        lambda v, i: F.try_subtract(
            F.try_multiply(v.cast("decimal(19,0)"), F.lit(str(n)).cast("decimal(19,0)")),
            F.get(sums, i),
        ).cast(_EXACT),
    )
    square = F.transform(off, lambda d: F.try_multiply(d, d).cast(_EXACT))
    total = F.aggregate(
        square, F.lit("0").cast(_EXACT), lambda a, b: F.try_add(a, b).cast(_EXACT)
    )
    return total.try_cast("long")


def _blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows ``(index, vector)`` of doubles as a matrix of dense blocks of bounded size."""
    columns = min(width, BLOCK_COLUMNS)
    vectors = rows.select("index", array_to_vector("vector").alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    matrix = IndexedRowMatrix(vectors, n, width)
    return matrix.toBlockMatrix(max(1, BLOCK_NUMBERS // columns), columns)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, the inner dimension dealt over ``splits`` tasks per result block:
    MLlib's Python method would send all blocks that make one result block to one task."""
    product = left._java_matrix_wrapper.call(
        "multiply", right._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, as a local array: as wide and high as a vector is long."""
    splits = -(-blocks.numRowBlocks // BLOCKS_PER_TASK)
    return _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()


def _projected(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``(index, vector)`` of the rows times a local matrix."""
    width, held = matrix.shape
    high = blocks.colsPerBlock
    parts = [
        ((i, 0), DenseMatrix(len(part), held, part.ravel(order="F")))
        for i, part in enumerate(matrix[at : at + high] for at in range(0, width, high))
    ]
    right = BlockMatrix(spark.sparkContext.parallelize(parts, 1), high, held, width, held)
    product = _product(blocks, right, 1).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("vector"))


def _identity_error(rows: DataFrame, n: int, held: int) -> float:
    """The largest entry of the rows' covariance minus the identity."""
    means = rows.agg(*[F.avg(F.get("vector", F.lit(i))) for i in range(held)]).first()
    middle = F.array(*[F.lit(float(m)) for m in means])
    centred = F.transform("vector", lambda v, i: v - F.get(middle, i))
    covariance = _scatter(_blocks(rows.select("index", centred.alias("vector")), n, held)) / n
    return float(np.abs(covariance - np.eye(held)).max())
