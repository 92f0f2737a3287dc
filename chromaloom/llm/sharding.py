"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.session import materialise, small_side

SEED = 20_261
# Blocks of consecutive rows whose labels are permuted in one place: at most so many, each at least so long.
MAX_BLOCKS, LEAST_BLOCK = 4096, 1024
# Rows of a shard ordered in one task.
ORDER_ROWS = 200_000
# Above this numpy's own sampler refuses; the mass function is then inverted around its mode.
SAMPLER_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` out of ``good`` + ``bad``."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if max(good, bad) < SAMPLER_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mean = drawn * good / total
    spread = math.sqrt(mean * (bad / total) * max(total - drawn, 1) / max(total - 1, 1))
    low = max(0, drawn - bad, int(mean - 12 * spread - 30))
    high = min(drawn, good, int(mean + 12 * spread + 30))
    # Ratios of neighbouring terms, so no large logarithms cancel.
    k = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1) * (drawn - k) / (bad - drawn + k + 1)))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1]))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard, for a uniform permutation of all rows.

    Shard sizes differ by one at most. Block by block, a multivariate hypergeometric draw takes the block's
    rows out of the room that is left in the shards.
    """
    total, rng = sum(rows), np.random.default_rng(seed)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = np.zeros((len(rows), shards), np.int64)
    for i, need in enumerate(rows):
        others = sum(room)
        for j in range(shards):
            others -= room[j]
            matrix[i, j] = hypergeometric(rng, room[j], others, need)
            need -= matrix[i, j]
        for j in range(shards):
            room[j] -= int(matrix[i, j])
    return matrix


def _labeller(matrix: np.ndarray, block_rows: int, seed: int):
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for places in batches:
            place = places.to_numpy()
            block, at = place // block_rows, place % block_rows
            out = np.empty(len(place), np.int32)
            for b in np.unique(block):
                if b not in kept:
                    labels = np.repeat(np.arange(matrix.shape[1], dtype=np.int16), matrix[b])
                    np.random.default_rng([seed, int(b)]).shuffle(labels)
                    kept[b] = labels
                    if len(kept) > 4:
                        kept.popitem(last=False)
                mine = block == b
                out[mine] = kept[b][at[mine]]
            yield pd.Series(out)

    return F.pandas_udf(label, "int")


def shuffle_to_shards(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    Every arrangement of the rows over all places is equally likely, and shard counts differ by one at
    most. Rows are written with their split and place, so that they have fixed numbers however often a
    task runs; runs of numbers are the blocks of the communication matrix. A row's shard follows from its
    number alone (the block's labels, permuted with the block's own seed). The exchange sends rows to
    (shard, range of a random key); the key's order, ranges first, is the second permutation. What the
    driver holds is one count per input split, and blocks x shards numbers (at most MAX_BLOCKS blocks).

    Columns named shard or slot are replaced. Nulls, repeated rows and ties do not matter, as rows are
    told apart by their number. An empty table gives an empty result; with fewer rows than shards, the
    later shards stay empty.
    """
    rows = rows.drop("shard", "slot")
    number = F.monotonically_increasing_id()
    placed = rows.withColumns({"_split": F.shiftright(number, 33), "_at": number.bitwiseAND((1 << 33) - 1)})
    placed = materialise(placed, "placed")
    splits = materialise(placed.groupBy("_split").agg(F.count(F.lit(1)).alias("n")), "splits")
    total = splits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block_rows = max(LEAST_BLOCK, -(-total // MAX_BLOCKS))
    lengths = [min(block_rows, total - k) for k in range(0, total, block_rows)]
    label = _labeller(communication_matrix(lengths, shards, seed), block_rows, seed)

    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = small_side(splits.select("_split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    numbered = placed.join(starts, "_split").withColumn("_number", F.col("_start") + F.col("_at"))
    key = F.xxhash64(F.lit(seed), "_number")
    ranges = max(1, -(-total // (shards * ORDER_ROWS)))
    sent = numbered.withColumns({"shard": label("_number"), "_key": key, "_range": F.pmod(key, F.lit(ranges))})
    if ranges == 1:
        offset, grouped = F.lit(0), sent
    else:
        counts = materialise(sent.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n")), "ranges")
        earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets, _ = small_side(counts.select("shard", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset")))
        grouped, offset = sent.join(offsets, ["shard", "_range"]), F.col("_offset")
    order = Window.partitionBy("shard", "_range").orderBy("_key", "_number")
    slot = (offset + F.row_number().over(order) - 1).cast("long")
    return grouped.withColumn("slot", slot).select(*rows.columns, "shard", "slot")


def text_size(text_col: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(16)).cast("long")
