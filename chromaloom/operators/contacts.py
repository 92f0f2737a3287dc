"""From raw contact triples to a symmetric cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import names, numeric
from chromaloom.session import small_side

# The normalisation tags a contact dump may carry.
NORMALISATIONS = ("NONE", "VC", "VC_SQRT", "KR", "SCALE")


def filter_chroms(df: DataFrame, cols: Sequence[str] = ("chrom1", "chrom2")) -> DataFrame:
    for name in cols:
        df = df.where(names.is_placed(F.col(name)))
    return df


def contact_mode(df: DataFrame, mode: int, header: Sequence[str] | None = None) -> DataFrame:
    """Keep the chromosome pairs of a mode and add their store key.

    Modes 2 and 3 keep pairs within one chromosome, keyed by its name. Modes 0 and 1 keep every
    pair in header order, keyed by both names. Odd modes are the dense form of the same rows
    (see ``image.densify``).
    """
    if mode not in (0, 1, 2, 3):
        raise ValueError(f"mode must be 0, 1, 2 or 3, not {mode}")
    if mode in (2, 3):
        return df.where(F.col("chrom1") == F.col("chrom2")).withColumn("store_key", F.col("chrom1"))
    if header is None:
        raise ValueError("modes 0 and 1 need the chromosome names in header order")
    order = F.array(*[F.lit(name) for name in header])
    first, second = (F.array_position(order, F.col(c)) for c in ("chrom1", "chrom2"))
    return df.where((first > 0) & (first <= second)).withColumn(
        "store_key", F.concat_ws("_", "chrom1", "chrom2")
    )


def bin_contacts(df: DataFrame, resolution: int) -> DataFrame:
    """Positions to bins; counts are held in single precision, nothing is mirrored."""
    return df.withColumns(
        {
            "row": numeric.bin_index(F.col("pos1"), resolution).cast("int"),
            "col": numeric.bin_index(F.col("pos2"), resolution).cast("int"),
            "value": F.col("counts").cast("float"),
        }
    ).drop("pos1", "pos2", "counts")


def stored_block(chrom: Column, first: Column, second: Column) -> Column:
    """Name of the store block that holds a cell, from its chromosome and the blocks of its two bins.

    The block of the smaller bin and the binary length of the distance to the other one, so blocks are fine along
    the diagonal, where windows lie, and wide far from it: a side of n blocks gives about n log n names, not n * n.
    """
    low, high = F.least(first, second), F.greatest(first, second)
    band = F.length(F.bin(high - low + 1)) - 1
    return F.concat_ws(".", chrom, low.cast("string"), band.cast("string"))


def with_block(binned: DataFrame, block: int) -> DataFrame:
    """Binned contacts with the name of their store block."""
    first, second = (F.floor(F.col(c) / block) for c in ("row", "col"))
    return binned.withColumn("block", stored_block(F.col("chrom1"), first, second))


def pair_stats(binned: DataFrame) -> DataFrame:
    """One pass over the contacts: everything later steps need to know about each chromosome pair.

    Write the result (``session.materialise``) and derive dimensions, dropped pairs and totals
    from it, so the contacts are read once for all of them.
    """
    return binned.groupBy("accession", "chrom1", "chrom2").agg(
        F.max("row").alias("max_row"),
        F.max("col").alias("max_col"),
        F.sum(F.col("value").cast("double")).alias("total"),
        F.count(F.lit(1)).alias("n_entries"),
    )


def nonzero_pairs(stats: DataFrame) -> DataFrame:
    """Pairs whose counts add up to zero hold no data; a NaN sum is kept."""
    return stats.where(F.isnan("total") | (F.col("total") != 0))


def _shape() -> tuple[Column, Column]:
    side = F.greatest("max_row", "max_col") + 1
    cis = F.col("chrom1") == F.col("chrom2")
    return (
        F.when(cis, side).otherwise(F.col("max_row") + 1),
        F.when(cis, side).otherwise(F.col("max_col") + 1),
    )


def dims_from_stats(stats: DataFrame) -> DataFrame:
    """Matrix shape as the data has it: square within a chromosome, separate sides across two."""
    n_rows, n_cols = _shape()
    return stats.select(
        "accession", "chrom1", "chrom2", n_rows.alias("n_rows"), n_cols.alias("n_cols")
    )


def matrix_dims(binned: DataFrame) -> DataFrame:
    return dims_from_stats(pair_stats(binned))


def large_enough(dims: DataFrame, height: int, width: int) -> DataFrame:
    return dims.where((F.col("n_rows") >= height) & (F.col("n_cols") >= width))


def keep_pairs(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Semi join on the chromosome pair; ``kept`` is a written table and is broadcast if small."""
    kept, _ = small_side(kept.select("accession", "chrom1", "chrom2"))
    return df.join(kept, ["accession", "chrom1", "chrom2"], "left_semi")


def drop_zero_pairs(df: DataFrame, stats: DataFrame) -> DataFrame:
    return keep_pairs(df, nonzero_pairs(stats))


def drop_small_chroms(df: DataFrame, dims: DataFrame, height: int, width: int) -> DataFrame:
    return keep_pairs(df, large_enough(dims, height, width))


def total_from_stats(stats: DataFrame, height: int, width: int) -> DataFrame:
    """Sum of unmirrored counts over large enough chromosomes; 0 for an accession without any."""
    n_rows, n_cols = _shape()
    keep = (n_rows >= height) & (n_cols >= width)
    return stats.groupBy("accession").agg(
        F.coalesce(F.sum(F.when(keep, F.col("total"))), F.lit(0.0)).alias("total_count")
    )


def total_count(binned: DataFrame, height: int, width: int) -> DataFrame:
    return total_from_stats(pair_stats(binned), height, width)


def mirror(df: DataFrame) -> DataFrame:
    """Both triangles of each within-chromosome matrix.

    A diagonal cell would be met twice at half its count, which is the cell itself.
    """
    here = F.struct(F.col("row").alias("row"), F.col("col").alias("col"))
    there = F.struct(F.col("col").alias("row"), F.col("row").alias("col"))
    both = F.when(F.col("row") == F.col("col"), F.array(here)).otherwise(F.array(here, there))
    return df.select(
        "accession", F.col("chrom1").alias("chrom"), F.explode(both).alias("cell"), "value"
    ).select("accession", "chrom", "cell.row", "cell.col", "value")


def sum_cells(mirrored: DataFrame) -> DataFrame:
    """Add up repeated cells; partial sums are formed before the shuffle."""
    return mirrored.groupBy("accession", "chrom", "row", "col").agg(
        F.sum(F.col("value").cast("double")).cast("float").alias("value")
    )


def symmetrise(df: DataFrame) -> DataFrame:
    return sum_cells(mirror(df))


def check_distinct_names(stats: DataFrame) -> DataFrame:
    """Names such as ``1`` and ``chr1`` in one store would overwrite each other: refuse them.

    Asked of the written statistics, which have one row per name.
    """
    clash = (
        stats.select("accession", "chrom1", names.normalize_chrom(F.col("chrom1")).alias("chrom"))
        .distinct()
        .groupBy("accession", "chrom")
        .count()
        .where("count > 1")
        .limit(1)
        .collect()
    )
    if clash:
        raise ValueError(f"{clash[0].accession} names {clash[0].chrom} in two ways")
    return stats


def prefix_names(df: DataFrame) -> DataFrame:
    return df.withColumns({c: names.normalize_chrom(F.col(c)) for c in ("chrom1", "chrom2")})
