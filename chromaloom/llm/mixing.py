"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chromaloom.llm.common import word_count
from chromaloom.session import materialise, small_side

SEED = "mix-1"
# Hex digits of the order key that cut a source into ranges, so that no source is ordered in one task.
RANGE_DIGITS = 3


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): weights repeat along the sources in code point order, null last.

    ``sources`` has one row per source; they are numbered in one task, as their number does not follow the rows.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.select("source", F.get(weights, (place % len(cycle)).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size, weight).

    Targets follow the weights and sum to ``share`` of all sizes; a source stops at ``epochs`` times its
    size and what it leaves is shared by the others by weight, until none is above. Sorted by the weight's
    price of its cap, clamped sources come first, so running sums give the fixed point directly. Sources of
    size 0 have target 0. Where every source is clamped (``share`` above ``epochs``) the sum stays short.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    ordered = Window.orderBy("price", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    priced = sources.withColumns({"cap": cap, "price": cap / F.col("weight")})
    running = priced.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = F.col("budget") / F.col("left_weight")
    own_level = F.when(F.col("cap") > F.col("weight") * level, level)
    all_rows = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = running.withColumn("level", F.first(own_level, ignorenulls=True).over(all_rows))
    target = F.least("cap", F.col("weight") * F.col("level"))
    return filled.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, seed: str) -> DataFrame:
    """``docs`` with _mix_size, the words, and _mix_key, the seeded order within a source."""
    sized = docs.withColumn("_mix_size", word_count(text_col))
    identity = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_mix_size").cast("string"))
    return sized.withColumn("_mix_key", F.md5(identity.cast("binary")))


def plan(
    docs: DataFrame,
    weights,
    share: float = 1.5,
    epochs: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = SEED,
) -> DataFrame:
    """(source, source_size, target, whole, cut): what each source gives.

    ``weights`` maps the table of sources to (source, weight). Every document of a source is taken
    ``whole`` times, and once more where its order key (md5 of seed, id and size) is at most ``cut``. The
    cut lies where the running size comes nearest to the words still wanted. Documents are summed by
    ranges of the key first; only the range that holds the cut is ordered, so a source with most of all
    rows is no single group. Rows of one id and size share a key and are taken alike.
    """
    keyed = _keyed(docs.select(id_col, source_col, text_col), id_col, text_col, seed)
    sized = keyed.selectExpr(f"CAST(`{source_col}` AS STRING) AS source", "_mix_size AS size", "_mix_key AS key")
    sized = materialise(sized, "sizes")
    ranges = sized.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size"))
    ranges = materialise(ranges, "ranges")
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    weighted = sizes.alias("s").join(weights(sizes.select("source")).alias("w"), F.expr("s.source <=> w.source"))
    aims = targets(weighted.select("s.source", "source_size", "weight"), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aims = aims.withColumn("whole", whole.cast("long"))
    aims = materialise(aims.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    small, _ = small_side(aims.select(F.col("source").alias("of"), "want"))
    placed = placed.join(small, F.expr("source <=> of")).drop("of")
    border = placed.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("range_size") > F.col("want")))
    filled = placed.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("range_size") <= F.col("want")))
    full_cut = filled.groupBy("source").agg(F.max(F.concat("range", F.lit("g"))).alias("cut"))
    border, _ = small_side(materialise(border.select(F.col("source").alias("of"), F.col("range").alias("at"), "before", "want"), "borders"))
    inside = sized.join(border, F.expr(f"source <=> of AND substring(key, 1, {RANGE_DIGITS}) = at"))
    inside = inside.groupBy("source", "key", "before", "want").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    reached = inside.withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    taken = reached.where((F.col("reached") < F.col("want")) & (2 * F.col("reached") + F.col("size") <= 2 * F.col("want")))
    cuts = taken.groupBy("source").agg(F.max("key").alias("cut")).unionByName(full_cut)
    cuts = cuts.groupBy(F.col("source").alias("of")).agg(F.max("cut").alias("cut"))
    return aims.join(cuts, F.expr("source <=> of"), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")
    )


def apply_plan(
    docs: DataFrame,
    planned: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words: size x copies).

    The plan has one row per source and is broadcast after its rows were counted. Columns of the same
    names in ``docs`` are replaced. Null texts have size 0; a null source is a source of its own.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    key = _keyed(docs.drop(*made), id_col, text_col, seed)
    small, _ = small_side(materialise(planned.select(F.struct("*").alias("_mix")), "mix-plan"))
    joined = key.join(small, F.col(source_col).cast("string").eqNullSafe(F.col("_mix.source")))
    copies = F.col("_mix.whole") + F.when(F.col("_mix_key") <= F.col("_mix.cut"), 1).otherwise(0)
    return joined.select(
        *[c for c in docs.columns if c not in made],
        F.col("_mix_size").alias("size"),
        F.col("_mix.source_size").alias("source_size"),
        F.col("_mix.target").alias("target"),
        copies.alias("copies"),
        (F.col("_mix_size") * copies).alias("taken"),
    )


def mix(docs: DataFrame, weights=cyclic_weights, share: float = 1.5, epochs: float = 2.0, **columns: str) -> DataFrame:
    """``docs`` with the copies each document has in the mix; rows with 0 copies stay, with taken 0.

    An empty table gives an empty result.
    """
    return apply_plan(docs, plan(docs, weights, share, epochs, **columns), **columns)


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row of ``mixed`` as often as its copies say, with ``columns`` only."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return mixed.where("copies > 0").select(*columns, times).drop("_copy")
