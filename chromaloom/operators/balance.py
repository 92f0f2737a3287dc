"""Normalisation of raw contact matrices, one per (accession, chrom).

``cells`` are symmetric (``contacts.symmetrise``). Every bin gets a factor, and a cell is divided by those of its
two bins; factors are scaled so that a matrix keeps its total. Bins without counts have no factor. Factors are a table that
is joined, never collected: it is broadcast while it is counted as small and meets the cells in a shuffle beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.operators.contacts import NORMALISATIONS
from chromaloom.session import materialise, small_side

MATRIX = ["accession", "chrom"]
BIN = [*MATRIX, "bin"]


def margins(cells: DataFrame, value: str = "value") -> DataFrame:
    """Sum of each matrix row that is not zero, as (accession, chrom, bin, margin)."""
    sums = cells.groupBy(*MATRIX, F.col("row").alias("bin")).agg(F.sum(F.col(value).cast("double")).alias("margin"))
    return sums.where(F.col("margin") > 0)


def divide(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """Cells over the factors of their bins; cells of a bin without a factor fall out."""
    factors, _ = small_side(factors.select(*BIN, "factor"))
    for side in ("row", "col"):
        own = factors.select(*MATRIX, F.col("bin").alias(side), F.col("factor").alias(f"_{side}"))
        cells = cells.join(own, [*MATRIX, side])
    return cells.withColumn("value", F.col("value").cast("double") / (F.col("_row") * F.col("_col"))).drop("_row", "_col")


def _scaled(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """Factors times one number per matrix, so that its total stays."""
    factors = materialise(factors, "factors")
    before = cells.groupBy(*MATRIX).agg(F.sum(F.col("value").cast("double")).alias("_before"))
    after = divide(cells, factors).groupBy(*MATRIX).agg(F.sum("value").alias("_after"))
    ratio, _ = small_side(materialise(before.join(after, MATRIX).select(*MATRIX, F.sqrt(F.col("_after") / F.col("_before")).alias("_by")), "totals"))
    return factors.join(ratio, MATRIX).withColumn("factor", F.col("factor") * F.col("_by")).drop("_by")


def coverage_factors(cells: DataFrame, root: bool = False) -> DataFrame:
    """Factors of VC, the margins, or of VC_SQRT, their roots."""
    margin = F.col("margin")
    return _scaled(cells, margins(cells).select(*BIN, (F.sqrt(margin) if root else margin).alias("factor")))


def balanced_factors(cells: DataFrame, tolerance: float = 1e-4, max_rounds: int = 200) -> DataFrame:
    """Factors that make all margins of a matrix equal, with the ``residual`` and ``rounds`` of their matrix.

    Each round multiplies a factor by the root of its bin's margin over the mean margin. A matrix is done when no margin is
    further than ``tolerance`` (relative) from the mean, and its cells then find no factors to meet; one that is not
    done after ``max_rounds``, as matrices without enough cells off zero may never be, is an error. Every round is one
    sum by row over the cells, which stay where they were written, and writes its factors, so that a lost
    executor costs one round.
    """
    cells = materialise(cells.select(*MATRIX, "row", "col", F.col("value").cast("double").alias("value")).where("value > 0"), "cells")
    factors = materialise(margins(cells).select(*BIN, F.sqrt("margin").alias("factor")), "factors")
    done: list[DataFrame] = []
    for rounds in range(max_rounds + 1):
        balanced = margins(divide(cells, factors)).join(factors, BIN)
        state = materialise(balanced, "margins")
        means = state.groupBy(*MATRIX).agg(F.avg("margin").alias("mean"), F.min("margin").alias("least"), F.max("margin").alias("most"))
        means = means.select(*MATRIX, "mean", (F.greatest(F.col("most") - F.col("mean"), F.col("mean") - F.col("least")) / F.col("mean")).alias("residual"))
        means, _ = small_side(materialise(means, "residuals"))
        state = state.join(means, MATRIX)
        is_done: Column = F.col("residual") <= tolerance
        done.append(state.where(is_done).select(*BIN, "factor", "residual", F.lit(rounds).alias("rounds")))
        worst = means.where(~is_done).agg(F.max("residual")).first()[0]
        if worst is None:
            return _scaled(cells, reduce(DataFrame.unionByName, done))
        factors = state.where(~is_done).select(*BIN, (F.col("factor") * F.sqrt(F.col("margin") / F.col("mean"))).alias("factor"))
        factors = materialise(factors, "factors")
    raise ValueError(f"a matrix is still {worst} off balance after {max_rounds} rounds")


def normalise(cells: DataFrame, norm: str) -> DataFrame:
    """Cells under a normalisation tag: as they are, by coverage (VC, VC_SQRT), or balanced (KR, SCALE)."""
    if norm not in NORMALISATIONS:
        raise ValueError(f"normalisation {norm} is none of {', '.join(NORMALISATIONS)}")
    if norm == "NONE":
        return cells
    written = materialise(cells, "cells")
    by = balanced_factors(written) if norm in ("KR", "SCALE") else coverage_factors(written, norm == "VC_SQRT")
    return divide(written, materialise(by, "factors"))
