"""Tables that several queries start from, and the fixed linear model they score with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.operators import contacts, infer, labels, perturb, sequence, skew, windows
from chromaloom.plans import pipelines
from chromaloom.plans.ctes import build
from chromaloom.plans.fixtures import BANDS, CONTEXT, HEIGHT, OFFSET, RESOLUTION, WIDTH, fixture
from chromaloom.session import materialise
from chromaloom.sources import fasta

CHUNK = 4096


def half_sql(x: str) -> str:
    """Nearest half-precision value in SQL, for finite values below the overflow."""
    unit = f"pow(2.0::DOUBLE, greatest(floor(log2(abs(CASE WHEN {x} = 0 THEN 1 ELSE {x} END))), -14) - 10)"
    return f"round_even({x} / {unit}, 0) * {unit}"


def cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.prefix_names(pipelines.cis_contacts(fixture(spark, sf_dir, "fx_contacts"), RESOLUTION))


def window_job(spark: SparkSession, sf_dir: str) -> pipelines.WindowJob:
    raw, bedpe = fixture(spark, sf_dir, "fx_contacts"), fixture(spark, sf_dir, "fx_regions")
    return pipelines.contact_windows(raw, bedpe, RESOLUTION, HEIGHT, WIDTH)


def records(spark: SparkSession, sf_dir: str, half: bool = True) -> DataFrame:
    return pipelines.window_records(window_job(spark, sf_dir), half)


def empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = window_job(spark, sf_dir)
    return windows.empty_windows(job.valid, job.cells)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_job(spark, sf_dir).cells


# Model rows of one task; more tasks than cores come from more rows, fewer from none.
TASK_ROWS = 4096


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many model rows: at least one a core, and one for every TASK_ROWS."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def item_count(spark: SparkSession, sf_dir: str) -> int:
    return fixture(spark, sf_dir, "fx_regions").count() * fixture(spark, sf_dir, "fx_biosamples").count()


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = window_job(spark, sf_dir)
    stored = materialise(pipelines.window_records(job), "records")
    return windows.assemble(fixture(spark, sf_dir, "fx_biosamples"), job.binned, stored, partitions=tasks(spark, item_count(spark, sf_dir)))


def labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "fx_pairs").where("organism = 'human'")
    return labels.label_join(fixture(spark, sf_dir, "fx_expr"), pairs, fixture(spark, sf_dir, "fx_genes"))


def labels_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "fx_pairs").where("organism = 'human'")
    return pipelines.expression_labels(
        fixture(spark, sf_dir, "fx_expr"), pairs, fixture(spark, sf_dir, "fx_genes"), fixture(spark, sf_dir, "fx_bio_split")
    )


def label_view(df: DataFrame) -> DataFrame:
    """Plain types; labels are single precision, so they are compared to four places."""
    return df.select(
        "seq_split", "bio_split", "bio_idx", "gene_idx", F.round(F.col("y").cast("double"), 4).alias("y"), "is_missing"
    )


def intervals(spark: SparkSession, sf_dir: str, bed: str) -> tuple[DataFrame, DataFrame]:
    """Intervals of the contigs that have a sequence, as in SQL, and the lengths of those contigs, a written table."""
    lengths = materialise(fasta.contig_lengths(fasta.contig_lines(fixture(spark, sf_dir, "fx_contigs"))), "contig-lengths")
    return sequence.on_contigs(fixture(spark, sf_dir, bed), lengths), lengths


def tokens(spark: SparkSession, sf_dir: str, known: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tokens of ``intervals``."""
    chunks = fasta.chunk_lines(fasta.contig_lines(fixture(spark, sf_dir, "fx_contigs")), CHUNK, CONTEXT)
    return sequence.fetch_sequences(known, chunks, lengths, CONTEXT, CHUNK, CONTEXT)


def bed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir, *intervals(spark, sf_dir, "fx_bed"))


def region_tokens(spark: SparkSession, sf_dir: str, regions: DataFrame) -> DataFrame:
    """Regions on contigs that have a sequence, with their tokens; among these, one without its token row is an error."""
    known, lengths = intervals(spark, sf_dir, "fx_region_bed")
    regions = regions.join(known.select(F.col("region_idx").alias("bedpe_idx")), "bedpe_idx", "left_semi")
    return sequence.seq_by_region(regions, tokens(spark, sf_dir, known, lengths), CONTEXT)


def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every biosample and region with their tokens, from buckets of the window key, as many as the model has
    tasks."""
    job = window_job(spark, sf_dir)
    regions = region_tokens(spark, sf_dir, job.binned.select("bedpe_idx", "chrom", "rs", "cs", "submat_key"))
    buckets = tasks(spark, item_count(spark, sf_dir))
    return windows.colocated_rows(fixture(spark, sf_dir, "fx_biosamples"), regions, pipelines.window_records(job), buckets)


def asked_targets(spark: SparkSession, sf_dir: str, stored: DataFrame) -> DataFrame:
    """Every target once per accession whose store has its window; ``unknown_windows`` lists the others."""
    targets = fixture(spark, sf_dir, "fx_targets").drop("gene_symbol", "enhancer_id", "regulated")
    return materialise(perturb.asked_targets(targets, stored), "asked")


def target_pairs(
    spark: SparkSession, sf_dir: str, with_tokens: bool = False, tops: bool = False, arrays: bool = True
) -> DataFrame:
    """The asked targets with their windows, by window and not written: a window is stored once, not once per target.

    With tokens, targets stay whose sequence interval lies on a contig that has a sequence, as in SQL.
    With ``tops`` the windows come with the maxima that images need, without ``arrays`` with their sizes as ``data``.
    """
    stored = records(spark, sf_dir)
    stored = materialise(perturb.edge_tops(stored, HEIGHT, WIDTH) if tops else stored, "records")
    asked = asked_targets(spark, sf_dir, stored)
    if not arrays:
        stored = stored.select("accession", "submat_key", F.size("data").alias("data"), "is_empty")
    spread = tasks(spark, asked.count()) if arrays else None
    rows = None
    if with_tokens:
        known, lengths = intervals(spark, sf_dir, "fx_region_bed")
        asked = asked.join(known.select(F.col("region_idx").alias("seq_row")), "seq_row", "left_semi").select(*asked.columns)
        rows = tokens(spark, sf_dir, known, lengths)
    return perturb.perturbation_pairs(asked, stored, rows, spread)


def expected_bands(spark: SparkSession, sf_dir: str) -> list[float]:
    return perturb.expectation(materialise(fixture(spark, sf_dir, "fx_k_median"), "bands"), BANDS)


def perturbed(spark: SparkSession, sf_dir: str, pairs: DataFrame, fill: str = "k_expected") -> DataFrame:
    bands = materialise(fixture(spark, sf_dir, "fx_k_median"), "bands") if fill == "k_expected" else None
    return perturb.perturb(pairs, bands, fill, HEIGHT, WIDTH, OFFSET, BANDS)


def vector_view(df: DataFrame, *keys: str) -> DataFrame:
    """One row per vector element, rounded."""
    rows = df.select(*keys, F.posexplode("vec").alias("d", "v"))
    return rows.select(*keys, F.col("d").cast("bigint").alias("d"), F.round(F.col("v").cast("double"), 6).alias("v"))


def grid_view(df: DataFrame, *keys: str) -> DataFrame:
    placed = df.withColumns({c: F.col(c).cast("bigint") for c in ("r", "c")})
    return vector_view(placed, *keys, "r", "c")


# The fixed linear model: weights per channel mean, per base frequency, and of the log total.
CHANNEL_WEIGHTS = (0.5, 0.25, -0.125)
BASE_WEIGHTS = (1.0, 2.0, 3.0, 4.0)
TOTAL_WEIGHT = 0.1


def joint_model() -> Callable:
    channel, base = np.array(CHANNEL_WEIGHTS), np.array(BASE_WEIGHTS)

    def fn(seq: np.ndarray, img: np.ndarray, total: np.ndarray) -> np.ndarray:
        return seq.mean(axis=1) @ base + img.mean(axis=(2, 3)) @ channel + TOTAL_WEIGHT * np.log10(total + 1)

    return fn


def contact_model() -> Callable:
    channel = np.array(CHANNEL_WEIGHTS)

    def fn(img: np.ndarray, total: np.ndarray) -> np.ndarray:
        return img.mean(axis=(2, 3)) @ channel + TOTAL_WEIGHT * np.log10(total + 1)

    return fn


def sequence_model() -> Callable:
    """Three outputs, one per training biosample, with weights one apart."""
    base = np.array(BASE_WEIGHTS)

    def fn(seq: np.ndarray) -> np.ndarray:
        return seq.mean(axis=1) @ (base[:, None] + np.arange(3)[None, :])

    return fn


def joint_gradient() -> Callable:
    channel, base = np.array(CHANNEL_WEIGHTS), np.array(BASE_WEIGHTS)

    def fn(seq: np.ndarray, img: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_seq = np.broadcast_to(base / seq.shape[1], seq.shape)
        by_img = np.broadcast_to((channel / (img.shape[2] * img.shape[3]))[:, None, None], img.shape)
        return by_seq, by_img

    return fn


IMAGE_SQL = (
    "0.5::DOUBLE * (red - 0.485::DOUBLE) / 0.229::DOUBLE + 0.25::DOUBLE * (green - 0.456::DOUBLE) / 0.224::DOUBLE"
    " - 0.125::DOUBLE * (green - 0.406::DOUBLE) / 0.225::DOUBLE"
)
SEQ_SQL = "(f0 + 2 * f1 + 3 * f2 + 4 * f3)"

ATTRIBUTION_SQL = build(
    f"""SELECT c.accession, c.bedpe_idx, round({SEQ_SQL}, 6) + 0.0::DOUBLE AS seq_total, round({IMAGE_SQL}, 6) + 0.0::DOUBLE AS hic_total
    FROM channel_means c JOIN freq f ON c.bedpe_idx = f.region_idx""",
    bed_source="fx_region_bed",
)


def attributions(spark: SparkSession, sf_dir: str, dtype: str = "float32", totals: bool = False) -> DataFrame:
    """The model runs in the buckets of its rows, so neither windows nor attributions are dealt out again."""
    return infer.input_x_gradient(
        bucket_rows(spark, sf_dir), joint_gradient, height=HEIGHT, width=WIDTH, batch_size=16, dtype=dtype, totals=totals
    )


def attribution_view(totals: DataFrame) -> DataFrame:
    return totals.select("accession", "bedpe_idx", *[F.round(c, 6).alias(c) for c in ("seq_total", "hic_total")])
