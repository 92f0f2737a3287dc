"""Ranks and positions without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import materialise, small_side


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Per key and different value: how often it occurs, how many rows lie before it, and the key's total.

    Ties are merged before anything is ordered. The merged values are range-partitioned and written with
    their partition number, which fixes the ranges for good; each range is then ordered on its own and
    starts from the total of the ranges before it.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(0))
        return value_ranks(whole, ["_all"], col, weight, buckets).drop("_all")
    keys = list(keys)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*keys, col).agg(amount.alias("n"))
    order = [*keys, col]
    spread = counted.repartitionByRange(buckets, *order) if buckets else counted.repartitionByRange(*order)
    ranged = materialise(spread.withColumn("_bucket", F.spark_partition_id()), "value-ranges")
    sizes = ranged.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("total"),
    )
    offsets, _ = small_side(materialise(offsets, "range-offsets"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .select(*keys, col, "n", (F.col("_offset") + F.col("_inside")).alias("before"), "total")
    )


def average_rank(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rank of each different value, ties sharing their mean rank."""
    ranked = value_ranks(df, keys, col)
    return ranked.select(*keys, col, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Position from 0 of each different ``order`` value within its key."""
    distinct = df.select(*keys, order).distinct()
    return value_ranks(distinct, keys, order).select(*keys, order, F.col("before").alias(name))


def vector_blocks(
    df: DataFrame, keys: Sequence[str], position: str, value: str, block: int = 4096
) -> DataFrame:
    """Matrix rows as runs of at most ``block`` values, so no row is gathered whole."""
    return (
        df.withColumn("block", F.floor(F.col(position) / block))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))).alias("e"))
        .select(*keys, "block", F.col("e")["p"][0].alias("first"), F.col("e")["v"].alias("values"))
    )
