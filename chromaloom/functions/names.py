"""Chromosome, window and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chromosomes held out for validation and for testing.
VAL_CHROMS = ("chr4",)
TEST_CHROMS = ("chr5", "chr11", "chr14")


def normalize_chrom(name: Column) -> Column:
    return F.when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def is_placed(name: Column) -> Column:
    """False for the whole-genome pseudo chromosome and for unplaced, random or alternate contigs.

    Only ``Un`` is matched with its case.
    """
    lowered = F.lower(name)
    return ~(
        lowered.contains("all")
        | lowered.contains("random")
        | lowered.contains("alt")
        | name.contains("Un")
    )


def submat_key(chrom: Column, row_start: Column, col_start: Column) -> Column:
    return F.concat(chrom, F.lit(":"), row_start.cast("string"), F.lit(","), col_start.cast("string"))


def parse_submat_key(key: Column) -> dict[str, Column]:
    pattern = r"^(.*):(-?\d+),(-?\d+)$"
    return {
        "chrom": F.regexp_extract(key, pattern, 1),
        "rs": F.regexp_extract(key, pattern, 2).cast("bigint"),
        "cs": F.regexp_extract(key, pattern, 3).cast("bigint"),
    }


def biosample_from_path(path: Column) -> Column:
    """Base name without its last extension; a leading dot is not an extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")


def genomic_split(
    chrom: Column, val: tuple[str, ...] = VAL_CHROMS, test: tuple[str, ...] = TEST_CHROMS
) -> Column:
    return (
        F.when(chrom.isin(*val), F.lit("val"))
        .when(chrom.isin(*test), F.lit("test"))
        .otherwise(F.lit("train"))
    )
