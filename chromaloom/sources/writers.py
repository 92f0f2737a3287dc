"""Writers. Each names its output by key columns, so a repeated run replaces the same partitions."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions import numeric
from chromaloom.operators import contacts
from chromaloom.session import materialise


def _replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Rows of a partition are brought together for few files; a partition that holds much of the table
    is split over tasks by the rebalance."""
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_contacts(df: DataFrame, path: str) -> None:
    _replace_partitions(df, path, "accession", "chrom1")


def write_tiled_contacts(binned: DataFrame, stats: DataFrame, path: str, resolution: int, block: int) -> None:
    """Binned contacts laid out by accession and matrix block, with the statistics of their chromosomes.

    The statistics (``contacts.pair_stats``, written last) hold the resolution and the block size, and spare a later
    job the pass over all contacts; accessions that the table lacks keep what is stored of them. An accession
    is replaced whole: blocks of an earlier run that it has no more are removed.
    """
    spark = binned.sparkSession
    placed = contacts.with_block(binned, block).select("accession", "chrom1", "row", "col", "value", "block")
    stats = stats.withColumns({"resolution": F.lit(resolution), "block_size": F.lit(block)})
    for name in {r.accession for r in stats.select("accession").distinct().collect()}:
        drop_partition(spark, f"{path}/_stats", "accession", name)
        drop_partition(spark, path, "accession", name)
    _replace_partitions(placed, path, "accession", "block")
    _replace_partitions(stats, f"{path}/_stats", "accession")


def write_windows(records: DataFrame, path: str) -> None:
    _replace_partitions(records, path, "accession")


def partition_values(spark: SparkSession, path: str, by: str) -> set[str]:
    """Values that a partitioned store has folders for; none where there is no store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return set()
    names = [status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory()]
    return {unquote(name.removeprefix(f"{by}=")) for name in names if name.startswith(f"{by}=")}


def drop_partition(spark: SparkSession, path: str, by: str, value: str) -> None:
    """Remove one partition's folder from a store, if it is there."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f"{by}=*")):
        if unquote(status.getPath().getName().removeprefix(f"{by}=")) == value:
            files.delete(status.getPath(), True)


def write_invalid_bed(empty: DataFrame, path: str | None = None, processed: DataFrame | None = None) -> int:
    """Chromosome and start bins of empty windows, one line per region row, by accession; returns their number.

    The windows are computed once. Lists of other accessions stay, an earlier list of the same accession is
    replaced, and that of a ``processed`` accession without empty windows is removed. Without a path nothing is
    written. The driver holds the names of the processed accessions.
    """
    rows = materialise(empty.select("accession", "bedpe_idx", "chrom", "rs", "cs"), "empty-windows")
    count = rows.count()
    if path and count:
        ordered = rows.repartitionByRange("accession", "bedpe_idx").sortWithinPartitions("accession", "bedpe_idx")
        lines = ordered.select("accession", "chrom", "rs", "cs").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        lines.partitionBy("accession").csv(path, sep="\t")
    if path and processed is not None:
        full = processed.select("accession").distinct().join(rows, "accession", "left_anti")
        for stale in partition_values(rows.sparkSession, path, "accession") & {r.accession for r in full.collect()}:
            drop_partition(rows.sparkSession, path, "accession", stale)
    return count


def write_labels(labels: DataFrame, path: str) -> None:
    """Nine tables, one per gene split and biosample split."""
    _replace_partitions(labels, path, "seq_split", "bio_split")


def write_tokens(tokens: DataFrame, path: str) -> None:
    tokens.repartitionByRange("region_idx").sortWithinPartitions("region_idx").write.mode("overwrite").parquet(path)


def write_embeddings(df: DataFrame, path: str, keys: tuple[str, ...], vec: str = "vec") -> None:
    """Half-precision vectors in key order (biosample-major when ``b`` comes first)."""
    half = F.transform(vec, lambda x: numeric.to_float16(x).cast("float"))
    rows = df.select(*keys, half.alias(vec))
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str, keys: tuple[str, ...] = ("bio_idx", "bedpe_idx")) -> None:
    """Rows in flat biosample-major order across the files."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_perturbation_csv(scored: DataFrame, path: str) -> None:
    """Target columns followed by y_orig, y_pert and delta, with header and without index."""
    tail = ["y_orig", "y_pert", "delta"]
    head = [c for c in scored.columns if c not in (*tail, "target_idx")]
    rows = scored.repartitionByRange("target_idx").sortWithinPartitions("target_idx")
    rows.select(*head, *tail).write.mode("overwrite").option("header", True).csv(path)


# Files that a task writes at once instead of sorting its rows by partition.
OPEN_FILES = 64


def write_attributions(df: DataFrame, path: str) -> None:
    """Sequence and contact attributions keyed by accession and region.

    One columnar table from one pass of the model; either attribution is read without the other. Rows are many times
    the size of what the model was given, so each task writes its own where they are made, unsorted and without an
    exchange; in the order of their windows they pack well.
    """
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    earlier = conf.get(name)
    conf.set(name, str(OPEN_FILES))
    try:
        rows = df.select("accession", "bedpe_idx", "seq_attr", "hic_attr")
        saved = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        saved.partitionBy("accession").parquet(path)
    finally:
        conf.set(name, earlier)


def pending(accessions: DataFrame, done: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Accessions still to do; with ``available`` only those whose input exists."""
    todo = accessions.join(done.select("accession").distinct(), "accession", "left_anti")
    if available is not None:
        todo = todo.join(available.select("accession").distinct(), "accession", "left_semi")
    return todo


def missing_inputs(accessions: DataFrame, available: DataFrame) -> DataFrame:
    """The warning list: listed accessions without input."""
    return accessions.join(available.select("accession").distinct(), "accession", "left_anti")


MARKERS = "windows bigint, accession string"


def completed(spark: SparkSession, path: str) -> DataFrame:
    """(accession, windows) of the accessions whose windows are all stored.

    A marker is written after its windows, so a run that broke off leaves none. A marker whose windows have gone
    does not count. The driver lists the store's folders.
    """
    if not partition_values(spark, f"{path}/_done", "accession"):
        return spark.createDataFrame([], MARKERS).select("accession", "windows")
    marked = spark.read.schema(MARKERS).parquet(f"{path}/_done")
    there = spark.createDataFrame([(v,) for v in sorted(partition_values(spark, path, "accession"))], "accession string")
    stored = marked.join(F.broadcast(there), "accession", "left_semi")
    return stored.unionByName(marked.where("windows = 0")).select("accession", "windows")


def commit_windows(records: DataFrame, path: str, processed: DataFrame) -> DataFrame:
    """Write the windows (a written table) of the ``processed`` accessions, then a marker for each of them.

    The marker holds the number of windows, which may be none. Returns the markers.
    """
    write_windows(records, path)
    counts = records.groupBy("accession").agg(F.count(F.lit(1)).alias("windows"))
    names = processed.select("accession").distinct()
    marks = materialise(names.join(counts, "accession", "left").select("accession", F.coalesce("windows", F.lit(0)).alias("windows")), "markers")
    _replace_partitions(marks, f"{path}/_done", "accession")
    return marks
