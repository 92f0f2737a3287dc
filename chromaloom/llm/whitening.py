"""Embedding whitening through MLlib's BlockMatrix: centred rows in blocks, scatter, eigenvectors, projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from chromaloom.session import materialise

COMPONENTS = 8
# Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# Rows of a block; the last one is filled up with zero rows, which add nothing to a scatter.
BLOCK_ROWS = 4096
# Tasks that a product summed over all blocks is dealt to, at most; each sends one d x d matrix.
SPLITS = 512
# A component with less variance than this share of the first one's is rounding error.
LEAST_SHARE = 1e-10
# Larger entries do not fit the whole numbers; their rows count as holding an infinite entry.
LARGEST = float(1 << 40)

BLOCKS = StructType(
    [
        StructField("blockIndex", StructType([StructField("row", LongType()), StructField("col", LongType())])),
        StructField("subMatrix", MatrixUDT()),
    ]
)


class Whitening:
    """Row count, sums by dimension, eigenvalues (falling), unit eigenvectors (columns) and the trace."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray):
        self.n, self.sums = n, sums
        covariance = (scatter + scatter.T) / (2 * n)
        values, vectors = np.linalg.eigh(covariance)
        # Either sign is an eigenvector; the largest entry is made positive, so that reruns agree.
        peaks = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
        self.values = np.maximum(values[::-1], 0.0)
        self.vectors = (vectors * np.where(peaks < 0, -1.0, 1.0))[:, ::-1]
        self.trace = float(np.trace(covariance))

    def kept(self, components: int) -> int:
        """Components up to the wanted number that vary beyond rounding."""
        return int((self.values[:components] > LEAST_SHARE * self.values[0]).sum())


def whole_numbers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` without null vectors and those with null or non-finite entries; column x holds whole numbers.

    Vectors of another length than most (of the shorter ones, if as many) cannot share a matrix: dropped, as
    are empty ones and those with entries of LARGEST and beyond.
    """
    vector = F.col(vector_col).cast("array<double>")
    # Comparisons with NaN and infinity come out false here, as NaN counts as larger than every number.
    fine = F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False))
    rows = vectors.where(fine & (F.size(vector) > 0))
    usual = rows.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return vectors.limit(0).withColumn("x", F.lit(None).cast("array<long>"))
    whole = F.transform(vector, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(F.size(vector_col) == usual["d"]).withColumn("x", whole)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (written, with _row from monotonically_increasing_id) with a gapless _index.

    Only the row counts of the writing tasks are put in order, one number each.
    """
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).count().orderBy("_part").toPandas()
    before = counts["count"].cumsum() - counts["count"]
    starts = rows.sparkSession.createDataFrame(
        list(zip(counts["_part"].tolist(), before.tolist())), "_part long, _start long"
    )
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_index", F.col("_start") + place)


def _block_matrix(indexed: DataFrame, n: int, sums: list[int], block_rows: int) -> BlockMatrix:
    """Centred rows in dense blocks; a group holds ``block_rows`` rows at most."""
    width, matrix_type = len(sums), to_arrow_type(MatrixUDT.sqlType())

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Entries of (n * x - sum) / n, a whole number before the division: nothing cancels.
        block, values = None, np.zeros((block_rows, width))
        for batch in batches:
            block = batch.column("block")[0]
            flat = batch.column("deviations").flatten().to_numpy().reshape(-1, width)
            values[batch.column("_index").to_numpy() % block_rows] = flat / n
        index = pa.StructArray.from_arrays([pa.array([block.as_py()]), pa.array([0])], ["row", "col"])
        kind = {field.name: field.type for field in matrix_type}
        ends = pa.array([0, values.size], pa.int32())
        fields = {
            "type": pa.array([1], pa.int8()),
            "numRows": pa.array([block_rows], pa.int32()),
            "numCols": pa.array([width], pa.int32()),
            "colPtrs": pa.nulls(1, kind["colPtrs"]),
            "rowIndices": pa.nulls(1, kind["rowIndices"]),
            "values": pa.ListArray.from_arrays(ends, pa.array(values.ravel("F")), type=kind["values"]),
            "isTransposed": pa.array([False]),
        }
        matrix = pa.StructArray.from_arrays([fields[name] for name in kind], fields=list(matrix_type))
        yield pa.RecordBatch.from_arrays([index, matrix], ["blockIndex", "subMatrix"])

    deviations = F.transform("x", lambda v, i: v * n - F.element_at(_longs(sums), i + 1))
    placed = indexed.select("_index", F.expr(f"_index div {block_rows}").alias("block"), deviations.alias("deviations"))
    blocks = placed.groupBy("block").applyInArrow(dense, BLOCKS)
    padded = -(-n // block_rows) * block_rows
    java = callMLlibFunc("createBlockMatrix", blocks, block_rows, width, padded, width)
    return BlockMatrix(java, block_rows, width)


def _longs(numbers: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in numbers])


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """The transpose times the matrix. The sum over all row blocks is dealt to several tasks, then added up."""
    left, right = matrix.transpose()._java_matrix_wrapper, matrix._java_matrix_wrapper
    product = left.call("multiply", right._java_model, max(1, min(blocks, SPLITS)))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _rows(matrix: BlockMatrix, n: int, width: int) -> DataFrame:
    """(_index, w) of the first ``n`` rows of a matrix in one column of blocks."""
    size = matrix.rowsPerBlock

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = next(iter(at.values()))
                order = "C" if found["isTransposed"].as_py() else "F"
                dense = found["values"].values.to_numpy().reshape(size, width, order=order)[: n - block * size]
                index = pa.array(np.arange(len(dense)) + block * size)
                ends = pa.array(np.arange(len(dense) + 1, dtype=np.int32) * width)
                values = pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([index, values], ["_index", "w"])

    found = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model)
    return found.mapInArrow(split, "_index long, w array<double>")


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Long table (``id_col``, component, n, deviation, whitened, explained, identity_error) of all usable rows.

    The model is fitted on all usable vectors. Rows are numbered without gaps, centred and laid into blocks;
    the driver holds the d x d scatter. Dropped rows are those ``whole_numbers`` drops. Repeated rows and ids
    and null ids each keep their own rows. ``deviation`` is exact, null where it passes 64 bits. Components
    that do not vary (one vector, constant dimensions, fewer vectors than dimensions) have a null ``whitened``
    and take no part in ``identity_error``, which is null if none varies. Vectors of fewer dimensions than
    ``components`` have as many components as dimensions. Without usable rows the result is empty. Other
    columns of ``vectors`` are not looked at.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    usable = whole_numbers(own, "_v").select("_id", "x")
    rows = materialise(usable.withColumn("_row", F.monotonically_increasing_id()), "whole-numbers")
    first = rows.select(F.size("x")).first()
    if first is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        nothing = spark.createDataFrame([], schema)
        return rows.limit(0).select(F.col("_id").alias(id_col)).crossJoin(nothing)
    width = first[0]
    n, *sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i]) for i in range(width)]).first()
    indexed = _numbered(rows)
    centred = _block_matrix(indexed, n, sums, block_rows)
    blocks = -(-n // block_rows)
    model = Whitening(n, sums, _scatter(centred, blocks))
    shown, kept = min(components, width), model.kept(components)
    spread = [float(v) for v in model.values[:shown]]
    error = None
    if kept:
        projection = model.vectors[:, :kept] / np.sqrt(model.values[:kept])
        local = Matrices.dense(width, kept, projection.ravel("F").tolist())
        right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), width, kept, width, kept)
        product = centred.multiply(right)
        projected = BlockMatrix(product._java_matrix_wrapper._java_model, block_rows, kept)
        placed = materialise(_rows(projected, n, kept), "whitened")
        means = np.array(placed.agg(*[F.avg(F.col("w")[i]) for i in range(kept)]).first(), float)
        covariance = _scatter(projected, blocks) / n - np.outer(means, means)
        error = float(np.abs(covariance - np.eye(kept)).max())
        indexed = indexed.join(placed, "_index")
    else:
        indexed = indexed.withColumn("w", F.array().cast("array<double>"))
    squares = F.transform("x", lambda v, i: F.try_subtract(F.try_multiply(v, F.lit(n)), F.element_at(_longs(sums), i + 1)))
    squares = F.transform(squares, lambda v: F.try_multiply(v, v))
    deviation = F.aggregate(squares, F.lit(0).cast("long"), lambda total, v: F.try_add(total, v))
    long_form = indexed.select(
        F.col("_id").alias(id_col),
        deviation.alias("deviation"),
        "w",
        F.explode(F.sequence(F.lit(1), F.lit(shown))).alias("component"),
    )
    shares = F.array(*[F.lit(v / model.trace if model.trace else 0.0) for v in spread])
    return long_form.select(
        id_col,
        F.col("component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"),
        F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
