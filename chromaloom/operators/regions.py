"""Regions of interest in bin coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import names, numeric
from chromaloom.operators import skew
from chromaloom.session import small_side


def region_bins(regions: DataFrame, resolution: int) -> DataFrame:
    return regions.withColumns(
        {
            name: numeric.bin_index(F.col(source), resolution)
            for name, source in (("rs", "start1"), ("re", "end1"), ("cs", "start2"), ("ce", "end2"))
        }
    )


def window_regions(regions: DataFrame, resolution: int) -> DataFrame:
    """Rows of a BEDPE table with their window key, start bins and flip flag."""
    chrom = names.normalize_chrom(F.col("chr1"))
    flip = F.coalesce(F.col("strand1") == "-", F.lit(False))
    return region_bins(regions, resolution).select(
        "bedpe_idx",
        chrom.alias("chrom"),
        "rs",
        "re",
        "cs",
        "ce",
        flip.alias("flip"),
        names.submat_key(chrom, F.col("rs"), F.col("cs")).alias("submat_key"),
    )


def _inside() -> Column:
    starts = (F.col("rs") >= 0) & (F.col("cs") >= 0)
    return starts & (F.col("rs") < F.col("n_rows")) & (F.col("cs") < F.col("n_cols"))


def valid_regions(binned: DataFrame, dims: DataFrame) -> DataFrame:
    """Regions that start inside a stored matrix, once per accession that has it.

    ``dims`` (accession, chrom, n_rows, n_cols) is a written table, broadcast if small.
    """
    dims, _ = small_side(dims)
    return binned.join(dims, "chrom").where(_inside())


def skipped_regions(binned: DataFrame, dims: DataFrame) -> DataFrame:
    """The log of the above: what each accession of ``dims`` leaves out."""
    accessions = dims.select("accession").distinct()
    pairs = skew.pair_all(accessions, binned, order="accession")
    dims, _ = small_side(dims)
    known = pairs.join(dims, ["accession", "chrom"], "left")
    return known.where(~F.coalesce(_inside(), F.lit(False))).withColumn(
        "reason", F.when(F.col("n_rows").isNull(), "chrom").otherwise("start")
    )


def clamp_regions(valid: DataFrame) -> DataFrame:
    """Ends held at the matrix edge, and the middle column."""
    return (
        valid.withColumn("re_clamped", F.least("re", "n_rows"))
        .withColumn("ce_clamped", F.least("ce", "n_cols"))
        .withColumn("mid", F.floor((F.col("cs") + F.col("ce_clamped")) / 2).cast("bigint"))
    )


def region_index(binned: DataFrame, dims: DataFrame) -> DataFrame:
    return clamp_regions(valid_regions(binned, dims))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key.

    An aggregate, so a key that holds much of the table is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
        .select(*keys, "last.*")
        .select(*df.columns)
    )
