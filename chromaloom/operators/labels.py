"""Expression labels across gene and biosample splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import names, numeric
from chromaloom.operators import ranks, skew
from chromaloom.session import materialise, small_side


def rna_to_hic(expr: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rename expression files to their contact accession; files without one are left out."""
    pairs, _ = small_side(materialise(pairs.select("rna_accession", "hic_accession"), "pairs"))
    return expr.join(pairs, "rna_accession").withColumnRenamed("hic_accession", "accession")


def check_files(mapped: DataFrame) -> DataFrame:
    """One expression file per contact accession. A gene that a file lists again gives a label for each row."""
    files = mapped.groupBy("accession").agg(F.count_distinct("rna_accession").alias("n"))
    double = files.where("n > 1").first()
    if double is not None:
        raise ValueError(f"{double.accession} has two expression files")
    return mapped


def genes_in_all_files(mapped: DataFrame, n_files: int | None = None) -> DataFrame:
    """Genes that every file has."""
    if n_files is None:
        n_files = mapped.select("accession").distinct().count()
    return (
        mapped.groupBy("gene_id")
        .agg(F.count_distinct("accession").alias("n"))
        .where(F.col("n") == n_files)
        .select("gene_id")
    )


def nan_guard(df: DataFrame, col: str) -> DataFrame:
    """Fail on the first missing value instead of passing it on."""
    bad = F.col(col).isNull() | F.isnan(col)
    message = F.concat(F.col("accession"), F.lit(f" {col} contains nan values"))
    return df.withColumn(col, F.when(bad, F.raise_error(message)).otherwise(F.col(col)))


def label_join(expr: DataFrame, pairs: DataFrame, genes: DataFrame, check: bool = True) -> DataFrame:
    """Log-scaled labels of annotated genes that occur in every mapped file."""
    # Text files are parsed once; the checks and the gene list read the written copy.
    mapped = materialise(rna_to_hic(expr, pairs).select("rna_accession", "accession", "gene_id", "tpm"), "expression")
    if check:
        check_files(mapped)
    common = genes_in_all_files(mapped)
    labelled = (
        mapped.join(common, "gene_id", "left_semi")
        .join(genes.select("gene_id", "gene_idx", "chrom"), "gene_id")
        .withColumn("y", numeric.log2_tpm(F.col("tpm")))
    )
    return nan_guard(labelled, "y").select(
        "accession",
        "gene_idx",
        "gene_id",
        names.genomic_split(F.col("chrom")).alias("seq_split"),
        "y",
    )


def biosample_split_join(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """One label per listed biosample and gene; a biosample without expression gets zeros.

    ``labels`` hold every kept gene for each of their accessions, so listed accessions only need
    the split attached and absent ones are paired with the genes.
    """
    splits = materialise(splits.select(F.col("split").alias("bio_split"), "bio_idx", "accession"), "splits")
    small, _ = small_side(splits)
    columns = ["seq_split", "bio_split", "bio_idx", "accession", "gene_idx"]
    found = labels.join(small, "accession").select(
        *columns, F.col("y").cast("float").alias("y"), F.lit(False).alias("is_missing")
    )
    absent = splits.join(labels.select("accession").distinct(), "accession", "left_anti")
    genes = labels.select("gene_idx", "seq_split").distinct()
    zeros = skew.pair_all(absent, genes, order="accession").select(
        *columns, F.lit(0.0).cast("float").alias("y"), F.lit(True).alias("is_missing")
    )
    return found.unionByName(zeros)


def split_sizes(labels: DataFrame) -> DataFrame:
    """Biosamples and genes of each of the nine label tables."""
    return labels.groupBy("seq_split", "bio_split").agg(
        F.count_distinct("bio_idx").alias("n_bios"), F.count_distinct("gene_idx").alias("n_seqs")
    )


def label_matrix(labels: DataFrame, block: int = 4096) -> DataFrame:
    """Rows of the nine label matrices as blocks, genes by their order in the annotation."""
    place = ranks.ordinal(labels, ["seq_split"], "gene_idx", "gene_pos")
    placed = labels.join(place, ["seq_split", "gene_idx"])
    return ranks.vector_blocks(placed, ["seq_split", "bio_split", "bio_idx"], "gene_pos", "y", block)
