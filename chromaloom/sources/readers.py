"""Readers of the input tables. All are lazy apart from the line numbering and the contract checks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions import names
from chromaloom.operators.contacts import NORMALISATIONS
from chromaloom.operators.regions import last_wins
from chromaloom.sources.lines import fields, not_blank, ordered_lines

CONTACT_SCHEMA = (
    "accession string, norm string, chrom1 string, chrom2 string, pos1 bigint, pos2 bigint, counts double"
)
TARGET_SCHEMA = (
    "submat_key string, r0 bigint, r1 bigint, c0 bigint, c1 bigint, seq_row bigint, "
    "gene_symbol string, enhancer_id string, Regulated int"
)
# Fixed values of the repository that serves accessions.
ACCESSION_MARK = "EN"
FILE_URL = "https://www.encodeproject.org/files/%1$s/@@download/%1$s.%2$s"


def read_contacts(spark: SparkSession, path: str, fmt: str = "tsv", norm: str = "NONE") -> DataFrame:
    """Contact triples of one normalisation from a text or Parquet dump."""
    if norm not in NORMALISATIONS:
        raise ValueError(f"normalisation {norm} is none of {', '.join(NORMALISATIONS)}")
    reader = spark.read.schema(CONTACT_SCHEMA)
    if fmt == "parquet":
        table = reader.parquet(path)
    elif fmt == "tsv":
        table = reader.csv(path, sep="\t")
    else:
        raise ValueError(f"format {fmt} is neither tsv nor parquet")
    return table.where(F.col("norm") == norm).drop("norm")


def _bedpe(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by position; further columns are ignored."""
    rows = fields(ordered_lines(spark, path, not_blank(), "bedpe_idx"))
    picked = [F.col("f")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())]
    table = rows.select("bedpe_idx", *picked)
    return table.withColumns({c: names.normalize_chrom(F.col(c)) for c in ("chr1", "chr2")})


_SIX = {
    "chr1": "string",
    "start1": "bigint",
    "end1": "bigint",
    "chr2": "string",
    "start2": "bigint",
    "end2": "bigint",
}


def read_bedpe10(spark: SparkSession, path: str) -> DataFrame:
    """Region pairs with name and strand; both sides must lie on one chromosome."""
    rest = {"name": "string", "score": "string", "strand1": "string", "strand2": "string"}
    table = _bedpe(spark, path, {**_SIX, **rest})
    if not table.where("chr1 <> chr2").isEmpty():
        raise ValueError("all rows of the region file must have chr1 equal to chr2")
    return table


def read_bedpe6(spark: SparkSession, path: str) -> DataFrame:
    return _bedpe(spark, path, _SIX)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals; the first line decides whether column 6 is a strand."""
    rows = fields(ordered_lines(spark, path, not_blank(), "region_idx"))
    first = rows.where("region_idx = 0").select(F.size("f").alias("n")).first()
    strand = F.col("f")[5] if first is not None and first.n >= 6 else F.lit("+")
    return rows.select(
        "region_idx",
        F.col("f")[0].alias("chrom"),
        F.col("f")[1].cast("bigint").alias("start_bp"),
        F.col("f")[2].cast("bigint").alias("end_bp"),
        strand.alias("strand"),
    )


def read_expression(spark: SparkSession, folder: str, by_folder: bool = False) -> DataFrame:
    """``gene_id`` and ``TPM`` of every ``*.tsv``; the file name is the accession.

    The files share one header; a file with another one is refused. With ``by_folder`` the accession
    is that of a folder ``rna_accession=...``, as a partitioned write leaves it.
    """
    if by_folder:
        table = spark.read.csv(folder, sep="\t", header=True, enforceSchema=False)
        return table.select(
            F.col("rna_accession").cast("string").alias("rna_accession"), "gene_id", F.col("TPM").cast("double").alias("tpm")
        )
    table = spark.read.csv(f"{folder}/*.tsv", sep="\t", header=True, enforceSchema=False)
    return table.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.tsv$", "").alias("rna_accession"),
        "gene_id",
        F.col("TPM").cast("double").alias("tpm"),
    )


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, trimmed, without blank and comment lines; the order is the index."""
    kept = ~F.col("value").rlike(r"^\s*(#.*)?$")
    rows = ordered_lines(spark, path, kept, "bio_idx")
    return rows.select("bio_idx", F.trim("value").alias("accession"))


def read_pairs(spark: SparkSession, path: str, organism: str = "human") -> DataFrame:
    """Expression accession to contact accession; a repeated name keeps its last row."""
    rows = fields(ordered_lines(spark, path, not_blank()))
    header = rows.where("line_idx = 0").select("f").first().f
    at = {name: header.index(name) for name in ("Organism", "RNA Accession", "Hi-C Accession")}
    table = rows.where("line_idx > 0").select(
        "line_idx",
        F.col("f")[at["Organism"]].alias("organism"),
        F.col("f")[at["RNA Accession"]].alias("rna_accession"),
        F.col("f")[at["Hi-C Accession"]].alias("hic_accession"),
    )
    table = organism_filter(table, organism)
    return last_wins(table, ["rna_accession"], "line_idx").select("rna_accession", "hic_accession")


def organism_filter(pairs: DataFrame, organism: str = "human") -> DataFrame:
    return pairs.where(F.col("organism") == organism)


def _indexed_csv(spark: SparkSession, path: str, index: str) -> DataFrame:
    """A CSV with header whose row order matters: numbered lines, parsed by position of the header."""
    rows = ordered_lines(spark, path, not_blank(), "line_idx")
    header = next(csv.reader([rows.where("line_idx = 0").first().value]))
    schema = ", ".join(f"`{name.strip().replace('`', '``')}` string" for name in header)
    parsed = F.from_csv("value", F.lit(schema)).alias("r")
    return rows.where("line_idx > 0").select((F.col("line_idx") - 1).alias(index), parsed).select(index, "r.*")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return _indexed_csv(spark, path, "gene_idx")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Perturbation blocks in file order; columns besides the known ones stay text."""
    table = _indexed_csv(spark, path, "target_idx")
    kinds = {"r0": "bigint", "r1": "bigint", "c0": "bigint", "c1": "bigint", "seq_row": "bigint"}
    typed = {c: F.col(c).cast(k) for c, k in kinds.items() if c in table.columns}
    if "Regulated" in table.columns:
        typed["Regulated"] = zero_or_one(F.col("Regulated"))
    return table.withColumns(typed)


def zero_or_one(flag: Column) -> Column:
    """A flag written as number or as true or false, as an integer."""
    word = F.lower(F.trim(flag.cast("string")))
    return F.when(word == "true", 1).when(word == "false", 0).otherwise(word.cast("int"))


def check_k_median(table: DataFrame, length: int) -> DataFrame:
    """The expectation must have exactly one value for each distance 0..length-1."""
    seen = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("k").alias("low"),
        F.max("k").alias("high"),
        F.count_distinct("k").alias("different"),
    ).first()
    if (seen.n, seen.different, seen.low, seen.high) != (length, length, 0, length - 1):
        raise ValueError(f"the expectation must hold the distances 0 to {length - 1} once each")
    return table


def read_k_median(spark: SparkSession, path: str, length: int = 576) -> DataFrame:
    return check_k_median(spark.read.schema("k bigint, value double").parquet(path), length)


def read_embeddings(spark: SparkSession, path: str, dim: int, vec: str = "vec") -> DataFrame:
    """Embedding rows; every vector must have the same length, divisible by ``dim``."""
    table = spark.read.parquet(path)
    return check_vectors(table, dim, vec)


def check_vectors(table: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    seen = table.agg(F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("high")).first()
    if seen.low != seen.high or (seen.low or 0) % dim:
        raise ValueError(f"vectors have {seen.low} to {seen.high} values, expected a multiple of {dim}")
    return table


def read_weights(spark: SparkSession, path: str | None, items: DataFrame) -> DataFrame:
    """One weight per item ``m``, 1 when no table is given; a table must cover the items exactly."""
    if path is None:
        return items.select("m", F.lit(1.0).alias("w"))
    return check_weights(spark.read.schema("m bigint, w double").parquet(path), items)


def check_weights(weights: DataFrame, items: DataFrame) -> DataFrame:
    found = items.select("m").join(weights, "m", "full_outer").agg(
        F.count("w").alias("n_weights"), F.count(F.lit(1)).alias("n_both")
    ).first()
    n_items = items.count()
    if not found.n_weights == found.n_both == n_items:
        raise ValueError(f"{found.n_weights} weights for {n_items} items")
    return weights


def fetch_manifest(accessions: DataFrame, extension: str) -> DataFrame:
    """Download address per known accession; ``is_known`` is false for the rest."""
    name: Column = F.col("accession")
    known = name.contains(ACCESSION_MARK)
    url = F.format_string(FILE_URL, name, F.lit(extension))
    return accessions.select("accession", known.alias("is_known"), F.when(known, url).alias("url"))


TILED = "chrom1 string, row int, col int, value float, accession string, block string"
TILED_STATS = (
    "chrom1 string, chrom2 string, max_row int, max_col int, total double, n_entries bigint, resolution int, block_size int, accession string"
)


def read_tiled_contacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contacts laid out by block, and the statistics of their chromosomes."""
    return spark.read.schema(TILED).parquet(path), spark.read.schema(TILED_STATS).parquet(f"{path}/_stats")
