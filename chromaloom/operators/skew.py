"""Joins and pairings that hold up when one key has much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.session import BROADCAST_ROWS, materialise, small_side

# Keys with more rows than this are joined apart from the rest.
HOT_ROWS = 1_000_000


def join_unique(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    *,
    counts: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` (unique in ``on``) without a hot key landing in one task.

    Rows of ``many`` differ from each other (they carry an index or were grouped before). Keys are counted with
    map-side partial sums, unless ``counts`` (keys and _n) tells them. Without keys of more than ``hot_rows`` rows
    this is an ordinary join. Rows of such keys go over a salted copy of their few partners, all other rows over the
    plain shuffle. ``partitions`` deals the rows of ``many`` by key into that many tasks, where few bytes make much work.
    """
    on = list(on)
    if counts is None:
        counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*on, "_n").where(F.col("_n") > hot_rows)
    hot = materialise(counts, "hot-keys")
    dealt = (lambda df, *by: df.repartition(partitions, *by)) if partitions else (lambda df, *by: df)
    if hot.isEmpty():
        return dealt(many, *on).join(one, on, how)
    pieces = F.ceil(F.col("_n") / hot_rows).cast("int")
    hot, _ = small_side(hot.select(*on, pieces.alias("_pieces")))
    rest = dealt(many.join(hot, on, "left_anti"), *on).join(one, on, how)
    # A salt from the row itself is the same when a task is run again.
    salt = F.pmod(F.xxhash64(*many.columns), F.col("_pieces"))
    salted_many = many.join(hot, on).withColumn("_salt", salt.cast("int")).drop("_pieces")
    copies = F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_salt")
    salted_one = one.join(hot, on).select(*one.columns, copies)
    return rest.unionByName(dealt(salted_many, *on, "_salt").join(salted_one, [*on, "_salt"], how).drop("_salt"))


def pair_all(few: DataFrame, many: DataFrame, order: str, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All pairs of two tables, which the result must hold by definition.

    ``few`` is written, counted, and broadcast whole or, beyond ``block_rows``, in blocks of about that many rows.
    ``many`` stays where it is, so the pairs are made in as many tasks as it has, without a shuffle.
    """
    few = materialise(few, "few")
    blocks = max(1, -(-few.count() // block_rows))
    dealt = few.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int"))
    pairs = None
    for block in range(blocks):
        # A key that the planner cannot fold keeps this a hash join.
        own = F.broadcast(dealt.where(F.col("_block") == block))
        met = own.join(many.withColumn("_block", F.pmod(F.xxhash64(*many.columns), F.lit(1)).cast("int") + block), "_block")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.drop("_block")
