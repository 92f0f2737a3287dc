"""Text lines with their position in the file, without leaving the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaloom.session import materialise, small_side


def ordered_lines(
    spark: SparkSession, path: str, keep: Column | None = None, index: str = "line_idx"
) -> DataFrame:
    """Lines of ``path`` numbered from 0 in file order; only lines matching ``keep`` count.

    Lines are tagged with the file block they come from and written once, so the numbering does not
    depend on how a later job happens to split the file. A block's first number is the running total
    of the blocks before it; only the block list (one row per split) is ordered as a whole.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    if keep is not None:
        lines = lines.where(keep)
    tagged = materialise(lines.withColumn("_seq", F.monotonically_increasing_id()), "lines")
    blocks = tagged.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_file",
        "_block",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    starts, _ = small_side(materialise(starts, "blocks"))
    return tagged.join(starts, ["_file", "_block"]).select(
        (F.col("_before") + F.col("_seq") - F.col("_first")).alias(index),
        "value",
        F.col("_file"),
        F.col("_block"),
    )


def not_blank() -> Column:
    return F.trim("value") != ""


def fields(lines: DataFrame, sep: str = "\t") -> DataFrame:
    return lines.withColumn("f", F.split("value", sep))
