"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a string of BITS hash bits (the sides of random hyperplanes through the mean) and
holds its strings sorted. A query descends to its longest shared prefix in all trees and ascends in all of
them at once, one bit at a time, until the vectors met (counted once a tree) are enough; those are measured.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.window import Window

from chromaloom.session import materialise, small_side

TREES, BITS, SEED = 32, 32, 11
# Vectors of a tree held sorted in one place.
BLOCK_ROWS = 100_000


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that can take part: an id, finite components, not all zero."""
    vec = F.col(vec_col).cast("array<double>")
    sound = F.coalesce(
        F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )
    return rows.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length, the shorter one of a tie; 0 for an empty table."""
    lengths = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return lengths[0]["n"] if lengths else 0


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _hasher(mean: np.ndarray, trees: int):
    def hashes(column: pa.Array) -> pa.Array:
        planes = np.random.default_rng(SEED).standard_normal((len(mean), trees * BITS))
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        parts = []
        vectors = _matrix(column) if len(column) else np.zeros((0, len(mean)))
        for k in range(0, len(vectors), 4096):
            sides = ((vectors[k : k + 4096] - mean) @ planes > 0).reshape(-1, trees, BITS)
            parts.append(sides @ weights)
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, trees), pa.int32()), pa.array(flat))

    return F.arrow_udf(hashes, "array<long>", ArrowUDFType.SCALAR)


def _ranges(sorted_hashes: np.ndarray, asked: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the sorted strings that share the first ``level`` bits with each asked one."""
    shift = BITS - level
    low = (asked >> shift) << shift
    return np.searchsorted(sorted_hashes, low), np.searchsorted(sorted_hashes, low + (np.int64(1) << shift))


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    candidates: float = 0.9,
    trees: int = TREES,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, by Euclidean distance.

    A query ascends until its trees together hold ``candidates`` times as many vectors as the table (counted
    once a tree). Its own id is no candidate; ties go to the smaller id. Vectors that are null, zero, of an
    unusual length, or hold null or non-finite components take no part, nor do rows without an id. Of equal
    vectors only the k + 1 smallest ids are indexed, as no other can be among a query's k. Fewer candidates
    than k give fewer rows; an empty table gives an empty result; other columns are not looked at.

    The sorted array of a tree is cut by leading bits into blocks of about ``block_rows``, and a block that
    holds more (vectors close together) is dealt into pieces by a hash of the id. Queries go to the pieces
    their prefix reaches. Each piece returns counts by level first, then its own k nearest.
    """
    index, asked = valid_vectors(rows, id_col, vec_col), valid_vectors(queries, id_col, vec_col)
    width = usual_length(index)
    index, asked = index.where(F.size("vec") == width), asked.where(F.size("vec") == width)
    copies = Window.partitionBy("vec").orderBy("id")
    index = materialise(index.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy"), "vectors")
    total = index.count()
    if total == 0:
        return asked.selectExpr("id AS query_id", "1 AS rank", "id AS vec_id", "CAST(0 AS DOUBLE) AS score").where("false")
    mean = np.array(index.agg(*[F.avg(F.col("vec")[j]) for j in range(width)]).first(), dtype=np.float64)
    hashes = _hasher(mean, trees)
    lead = max(0, math.ceil(math.log2(total / block_rows)))
    block = F.shiftrightunsigned("hash", BITS - lead).alias("block")
    index = materialise(index.withColumn("hashes", hashes("vec")), "hashed")
    asked = materialise(asked.withColumn("hashes", hashes("vec")), "hashed-queries")
    strings = index.select("id", "vec", F.posexplode("hashes").alias("tree", "hash")).select("*", block)
    wanted = asked.select(F.col("id").alias("query_id"), "vec", F.posexplode("hashes").alias("tree", "hash")).select("*", block)

    held = materialise(strings.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    held, _ = small_side(held.withColumn("pieces", F.ceil(F.col("n") / (2 * block_rows)).cast("int")))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")
    dealt = strings.join(held, ["tree", "block"]).select("tree", "block", piece, "id", "hash", "vec")
    every_piece = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    place = ["tree", "block", "piece"]

    def count(own: pa.Table, asking: pa.Table) -> pa.Table:
        strings_here = np.sort(own["hash"].to_numpy())
        hashed = asking["hash"].to_numpy()
        counts = np.zeros((len(hashed), BITS + 1), np.int64)
        for level in range(lead, BITS + 1):
            low, high = _ranges(strings_here, hashed, level)
            counts[:, level] = high - low
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, BITS + 1), pa.int32()), pa.array(counts.ravel()))
        return pa.table({"query_id": asking["query_id"].combine_chunks(), "counts": lists})

    fine = wanted.join(held, ["tree", "block"]).select("tree", "block", every_piece, "query_id", "hash")
    counted = dealt.select(*place, "hash").groupBy(*place).cogroup(fine.groupBy(*place)).applyInArrow(count, "query_id long, counts array<long>")
    if lead:  # levels above the blocks are counted from the blocks' sizes
        level = F.explode(F.sequence(F.lit(0), F.lit(lead - 1))).alias("level")
        prefix = F.expr(f"shiftrightunsigned(block, {lead} - level)").alias("prefix")
        wide = held.select("tree", "block", "n", level).select("tree", "level", prefix, "n")
        wide = wide.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"))
        above = wanted.select("query_id", "tree", "block", level).select("query_id", "tree", "level", prefix)
        above = above.join(wide, ["tree", "level", "prefix"])
        one = F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda x: F.when(x == F.col("level"), F.col("n")).otherwise(F.lit(0)))
        counted = counted.unionByName(above.select("query_id", one.alias("counts")))
    summed = counted.groupBy("query_id").agg(F.array(*[F.sum(F.col("counts")[j]) for j in range(BITS + 1)]).alias("counts"))
    # A vector is met at most once a tree, so these hold k others besides the query itself.
    enough = max((k + 1) * trees, math.ceil(candidates * total) + trees)
    reached = F.filter(F.sequence(F.lit(0), F.lit(BITS)), lambda x: (x == 0) | (F.element_at("counts", x + 1) >= enough))
    levels = materialise(summed.select("query_id", F.array_max(reached).alias("level")), "levels")

    nothing = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def measure(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not (own.num_rows and asking.num_rows):
            return nothing
        hashed = own["hash"].to_numpy()
        order = np.argsort(hashed, kind="stable")
        hashed, ids = hashed[order], own["id"].to_numpy()[order]
        vectors = _matrix(own["vec"])[order]
        questions = _matrix(asking["vec"])
        low, high = _ranges(hashed, asking["hash"].to_numpy(), asking["level"].to_numpy().astype(np.int64))
        out: list[tuple[np.ndarray, ...]] = []
        for j, query in enumerate(asking["query_id"].to_pylist()):
            mine = ids[low[j] : high[j]]
            distance = np.sqrt(((vectors[low[j] : high[j]] - questions[j]) ** 2).sum(1))
            distance[mine == query] = np.inf
            if len(mine) > k:
                near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                mine, distance = mine[near], distance[near]
            best = np.lexsort((mine, distance))[:k]
            best = best[np.isfinite(distance[best])]
            out.append((np.full(len(best), query), mine[best], distance[best]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    # A query goes to every block that shares the bits it has left, as far as blocks are told apart by them.
    reach = wanted.join(levels, "query_id").withColumn("left", F.least("level", F.lit(lead)))
    reach = reach.withColumn("prefix", F.expr(f"shiftrightunsigned(block, {lead} - left)")).drop("block")
    lefts = F.explode(F.sequence(F.lit(0), F.lit(lead))).alias("left")
    blocks = held.select("tree", "block", "pieces", lefts).withColumn("prefix", F.expr(f"shiftrightunsigned(block, {lead} - left)"))
    sent = reach.join(blocks, ["tree", "left", "prefix"]).select("tree", "block", every_piece, "query_id", "hash", "vec", "level")
    found = dealt.groupBy(*place).cogroup(sent.groupBy(*place)).applyInArrow(measure, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
