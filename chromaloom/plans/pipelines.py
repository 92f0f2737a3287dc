"""The three workflows, composed from operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.operators import contacts, labels, regions, windows
from chromaloom.session import BROADCAST_ROWS, materialise, small_side
from chromaloom.sources import readers, writers


@dataclass
class WindowJob:
    """Tables of the contacts-to-windows workflow, each made when it is first asked for."""

    raw: DataFrame
    bedpe: DataFrame
    resolution: int
    height: int
    width: int

    @cached_property
    def cis(self) -> DataFrame:
        return cis_contacts(self.raw, self.resolution)

    @cached_property
    def stats(self) -> DataFrame:
        """Per chromosome, from a written table."""
        named = contacts.check_distinct_names(materialise(contacts.pair_stats(self.cis), "pair-stats"))
        return contacts.prefix_names(named)

    @cached_property
    def dims(self) -> DataFrame:
        """accession, chrom, n_rows, n_cols of kept matrices, a written table."""
        sized = contacts.large_enough(contacts.dims_from_stats(contacts.nonzero_pairs(self.stats)), self.height, self.width)
        return materialise(sized.select("accession", F.col("chrom1").alias("chrom"), "n_rows", "n_cols"), "dims")

    @cached_property
    def kept(self) -> DataFrame:
        """Binned contacts of kept matrices, not mirrored."""
        pairs = self.dims.select("accession", F.col("chrom").alias("chrom1"), F.col("chrom").alias("chrom2"))
        return contacts.keep_pairs(contacts.prefix_names(self.cis), pairs)

    @cached_property
    def binned(self) -> DataFrame:
        """Region rows with bins, key and flip."""
        return regions.window_regions(self.bedpe, self.resolution)

    @cached_property
    def valid(self) -> DataFrame:
        """Region rows per accession."""
        return regions.valid_regions(self.binned, self.dims)

    @cached_property
    def cells(self) -> DataFrame:
        """Window cells, flipped."""
        wanted = windows.distinct_windows(self.binned)
        found = windows.extract_from_contacts(self.kept, wanted, self.height, self.width, self.dims)
        return windows.strand_flip(found, self.height, self.width)

    @cached_property
    def totals(self) -> DataFrame:
        """accession, total_count."""
        return contacts.total_from_stats(contacts.nonzero_pairs(self.stats), self.height, self.width)


@dataclass
class StoredWindowJob(WindowJob):
    """The same workflow over contacts laid out by block: only blocks that some window touches are read.

    The statistics come with the store, so nothing asks for the other blocks. Beyond ``broadcast_rows`` blocks the
    join is a shuffle and the scan is not pruned; the result is the same.
    """

    stored_stats: DataFrame
    block: int
    broadcast_rows: int = BROADCAST_ROWS

    @cached_property
    def stats(self) -> DataFrame:
        return self.stored_stats.select("accession", "chrom1", "chrom2", "max_row", "max_col", "total", "n_entries")

    @cached_property
    def touched(self) -> DataFrame:
        """Contacts of the blocks in use; partitions are pruned at run time by the broadcast blocks."""
        wanted = windows.distinct_windows(self.binned)
        blocks = materialise(windows.stored_blocks(wanted, self.height, self.width, self.block), "blocks")
        blocks, _ = small_side(blocks, self.broadcast_rows)
        # Partitions are pruned only by a side with a filter of its own; every block in use has a window.
        return self.raw.join(blocks.where("windows > 0").select("block"), "block", "left_semi")

    @cached_property
    def cis(self) -> DataFrame:
        return self.touched.select("accession", "chrom1", F.col("chrom1").alias("chrom2"), "row", "col", "value")


def cis_contacts(raw: DataFrame, resolution: int) -> DataFrame:
    """Placed chromosomes, pairs within one chromosome, binned; names as they are."""
    cis = contacts.contact_mode(contacts.filter_chroms(raw), 2).drop("store_key")
    return contacts.bin_contacts(cis, resolution)


def contact_windows(
    raw: DataFrame, bedpe: DataFrame, resolution: int = 1000, height: int = 192, width: int = 960
) -> WindowJob:
    """All accessions in one job: the contacts are read twice, once for the statistics of each
    chromosome and once for the cells that some window needs."""
    job = WindowJob(raw, bedpe, resolution, height, width)
    # The statistics also refuse two spellings of one chromosome, which must not wait for a member that needs them.
    _ = job.stats
    return job


# Bins of a store block: about 30 blocks along the largest human chromosome at 1 kb.
STORE_BLOCK = 8192


def store_contacts(raw: DataFrame, path: str, resolution: int = 1000, block: int = STORE_BLOCK) -> None:
    """Bin the contacts within chromosomes once and lay them out by block, for any number of window jobs."""
    cis = cis_contacts(raw, resolution)
    stats = contacts.check_distinct_names(materialise(contacts.pair_stats(cis), "pair-stats"))
    writers.write_tiled_contacts(contacts.prefix_names(cis), contacts.prefix_names(stats), path, resolution, block)


def stored_windows(
    spark: SparkSession, path: str, bedpe: DataFrame, resolution: int = 1000, height: int = 192, width: int = 960,
    broadcast_rows: int = BROADCAST_ROWS,
) -> StoredWindowJob:
    """The window job of ``store_contacts``' store. The store must be of this resolution and of one block size."""
    cells, stats = readers.read_tiled_contacts(spark, path)
    sizes = stats.select("resolution", "block_size").distinct().limit(2).collect()
    if len(sizes) > 1 or any(row.resolution != resolution for row in sizes):
        raise ValueError(f"{path} holds contacts of {[tuple(row) for row in sizes]} (resolution, block), not of resolution {resolution}")
    block = sizes[0].block_size if sizes else STORE_BLOCK
    return StoredWindowJob(cells, bedpe, resolution, height, width, stats, block, broadcast_rows)


def window_summary(job: WindowJob) -> DataFrame:
    return windows.window_stats(job.valid, job.cells)


def window_records(job: WindowJob, half: bool = True) -> DataFrame:
    return windows.window_records(job.valid, job.cells, job.totals, half)


def expression_labels(expr: DataFrame, pairs: DataFrame, genes: DataFrame, splits: DataFrame) -> DataFrame:
    """Labels of the three gene splits for the three biosample splits. The long labels are written once,
    as listed biosamples, absent ones and the gene list are all taken from them."""
    long = materialise(labels.label_join(expr, pairs, genes), "labels")
    return labels.biosample_split_join(long, splits)


def resume_windows(
    raw: DataFrame, bedpe: DataFrame, accessions: DataFrame, path: str, resolution: int = 1000, height: int = 192, width: int = 960
) -> DataFrame:
    """Bring a window store up to date: compute and commit only the listed accessions that it lacks.

    Returns (accession, windows) of those written now. Accessions without contacts are passed over, as
    ``missing_inputs`` lists them. Nothing is computed if nothing is missing.
    """
    spark = raw.sparkSession
    todo = materialise(writers.pending(accessions, writers.completed(spark, path), raw), "pending")
    if todo.isEmpty():
        return spark.createDataFrame([], "accession string, windows bigint")
    names, _ = small_side(todo.select("accession").distinct())
    job = contact_windows(raw.join(names, "accession", "left_semi"), bedpe, resolution, height, width)
    return writers.commit_windows(materialise(window_records(job), "records"), path, todo)
