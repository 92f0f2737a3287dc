"""FASTA text to overlapping chunks, line by line.

A contig is never held in one row: its lines get their offset from running totals within each file
block and across blocks, and are then gathered per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaloom.session import materialise, small_side
from chromaloom.sources.lines import not_blank, ordered_lines

# Lines longer than this are broken up, so an unwrapped contig still spreads.
PIECE = 4096

# Lines whose running totals one task takes at once, whatever the size of a file split.
BLOCK_LINES = 65_536


def read_fasta_lines(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sequence lines as (chrom, offset, bases); the name is the header's first word.

    Totals run over blocks of at most ``block_lines`` neighbouring lines of a file, and over the blocks.
    """
    lines = ordered_lines(spark, path, not_blank()).withColumn("_block", F.floor(F.col("line_idx") / block_lines))
    is_header = F.col("value").startswith(">")
    name = F.when(is_header, F.regexp_extract("value", r"^>\s*(\S*)", 1))
    lines = lines.select(
        "_file",
        "_block",
        "line_idx",
        "value",
        name.alias("header"),
        F.when(is_header, F.lit(0)).otherwise(F.length("value")).cast("bigint").alias("width"),
    )
    so_far = (
        Window.partitionBy("_file", "_block")
        .orderBy("line_idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = lines.withColumns(
        {
            "local_chrom": F.last("header", ignorenulls=True).over(so_far),
            "end": F.sum("width").over(so_far),
            "head_end": F.last(
                F.when(F.col("header").isNotNull(), F.struct("line_idx")), ignorenulls=True
            ).over(so_far)["line_idx"],
        }
    )
    local = materialise(local, "fasta-lines")
    # Bases before the header within the block, needed to restart the count at each contig.
    heads = local.where(F.col("header").isNotNull()).select(
        F.col("line_idx").alias("head_end"), F.col("end").alias("head_total")
    )
    blocks = local.groupBy("_file", "_block").agg(
        F.max("end").alias("bases"),
        F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line_idx"))).alias("last_chrom"),
        F.max(F.when(F.col("header").isNotNull(), F.col("end"))).alias("last_head_total"),
    )
    order = Window.partitionBy("_file").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.sum("bases").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("total_end", ends).withColumn(
        "last_head_abs", F.col("total_end") - F.col("bases") + F.col("last_head_total")
    )
    carried = blocks.select(
        "_file",
        "_block",
        (F.col("total_end") - F.col("bases")).alias("bases_before"),
        F.last("last_chrom", ignorenulls=True).over(earlier).alias("carried_chrom"),
        F.last("last_head_abs", ignorenulls=True).over(earlier).alias("carried_head"),
    )
    carried, _ = small_side(materialise(carried, "fasta-blocks"))
    heads, _ = small_side(materialise(heads, "fasta-heads"))
    start = F.col("bases_before") + F.col("end") - F.col("width")
    contig_start = F.when(
        F.col("head_total").isNotNull(), F.col("bases_before") + F.col("head_total")
    ).otherwise(F.col("carried_head"))
    return (
        local.where(F.col("header").isNull())
        .join(carried, ["_file", "_block"])
        .join(heads, "head_end", "left")
        .select(
            F.coalesce("local_chrom", "carried_chrom").alias("chrom"),
            (start - contig_start).alias("offset"),
            F.col("value").alias("bases"),
        )
    )


def contig_lines(contigs: DataFrame) -> DataFrame:
    """The same form from a table of whole contigs (chrom, seq)."""
    return contigs.select("chrom", F.lit(0).cast("bigint").alias("offset"), F.col("seq").alias("bases"))


def contig_lengths(lines: DataFrame) -> DataFrame:
    return lines.groupBy("chrom").agg(
        F.max(F.col("offset") + F.length("bases")).alias("contig_len")
    )


def chunk_lines(lines: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Chunks (chrom, chunk_idx, seq) that start every ``chunk`` bases and run ``halo`` bases past the
    next start, so any interval up to ``halo`` long lies in the chunk in which it starts."""
    pieces = lines.select(
        "chrom",
        "offset",
        F.posexplode(F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("i", "s"),
    ).select("chrom", (F.col("offset") + F.col("i") * PIECE).alias("at"), "s", F.length("s").alias("n"))
    first = F.greatest(F.floor((F.col("at") - halo) / chunk), F.lit(0))
    last = F.floor((F.col("at") + F.col("n") - 1) / chunk)
    spread = pieces.select("chrom", "at", "s", "n", F.explode(F.sequence(first, last)).alias("chunk_idx"))
    low = F.greatest(F.col("at"), F.col("chunk_idx") * chunk)
    high = F.least(F.col("at") + F.col("n"), (F.col("chunk_idx") + 1) * chunk + halo)
    cut = spread.select(
        "chrom",
        "chunk_idx",
        low.alias("low"),
        F.substring("s", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("s"),
    ).where(F.length("s") > 0)
    return cut.groupBy("chrom", "chunk_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "s"))), lambda p: p["s"]), "").alias("seq")
    )


def read_fasta(spark: SparkSession, path: str, chunk: int = 786_432, halo: int = 196_608) -> tuple[DataFrame, DataFrame]:
    """Chunk table and contig lengths of a FASTA file."""
    lines = materialise(read_fasta_lines(spark, path), "fasta-offsets")
    return chunk_lines(lines, chunk, halo), contig_lengths(lines)
