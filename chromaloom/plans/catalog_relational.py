"""Projections, filters, joins, aggregations and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions import names, numeric
from chromaloom.operators import (
    contacts,
    fusion,
    image,
    labels,
    metrics,
    perturb,
    ranks,
    regions,
    skew,
    windows,
)
from chromaloom.plans import features as ft
from chromaloom.plans.ctes import build
from chromaloom.plans.fixtures import BANDS, HEIGHT, OFFSET, RESOLUTION, WIDTH, fixture, table
from chromaloom.plans.registry import query
from chromaloom.session import materialise
from chromaloom.sources import readers


def _cell_view(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        F.col("row").cast("bigint").alias("row"),
        F.col("col").cast("bigint").alias("col"),
        F.col("value").cast("double").alias("value"),
    )


# Projections, filters, predicates.


@query(
    "b1_normalize_chrom",
    build(
        """SELECT accession, chrom1 AS raw, CASE WHEN chrom1 LIKE 'chr%' THEN chrom1 ELSE 'chr' || chrom1 END AS chrom, pos1
        FROM fx_contacts"""
    ),
)
def normalize_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture(spark, sf_dir, "fx_contacts")
    return raw.select("accession", F.col("chrom1").alias("raw"), names.normalize_chrom(F.col("chrom1")).alias("chrom"), "pos1")


@query("b2_filter_chroms", build("SELECT accession, chrom1, chrom2, pos1, pos2, counts FROM placed"))
def filter_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.filter_chroms(fixture(spark, sf_dir, "fx_contacts"))


# The fixture's chromosomes in header order.
HEADER = ["1", "chr2", "3", "4", "5"]


@query(
    "b3_contact_mode",
    build(
        """SELECT accession, chrom1, chrom2, pos1, pos2, counts, chrom1 || '_' || chrom2 AS store_key FROM placed
        WHERE list_position(['1', 'chr2', '3', '4', '5'], chrom1) <= list_position(['1', 'chr2', '3', '4', '5'], chrom2)"""
    ),
)
def contact_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = contacts.filter_chroms(fixture(spark, sf_dir, "fx_contacts"))
    return contacts.contact_mode(placed, 0, HEADER)


@query("b3_contact_mode_cis", build("SELECT accession, chrom1, chrom2, pos1, pos2, counts, chrom1 AS store_key FROM placed WHERE chrom1 = chrom2"))
def contact_mode_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.contact_mode(contacts.filter_chroms(fixture(spark, sf_dir, "fx_contacts")), 2)


@query("b4_bin_contacts", build("SELECT accession, chrom AS chrom1, row, col, value FROM cis"))
def bin_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_view(ft.cis(spark, sf_dir), "accession", "chrom1")


@query(
    "b5_drop_zero_pairs",
    build(
        """SELECT s.accession, s.chrom1, s.chrom2, s.pos1, s.pos2, s.counts FROM signed s
        SEMI JOIN (SELECT accession, chrom1, chrom2 FROM signed GROUP BY ALL HAVING sum(counts) <> 0) k
        ON s.accession = k.accession AND s.chrom1 = k.chrom1 AND s.chrom2 = k.chrom2""",
        signed="(SELECT accession, chrom1, chrom2, pos1, pos2, CASE WHEN chrom1 = '3' THEN 0 ELSE counts END AS counts FROM fx_contacts)",
    ),
)
def drop_zero_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture(spark, sf_dir, "fx_contacts").withColumn("counts", F.when(F.col("chrom1") == "3", 0.0).otherwise(F.col("counts")))
    placed = raw.withColumns({"row": numeric.bin_index(F.col("pos1"), RESOLUTION), "col": numeric.bin_index(F.col("pos2"), RESOLUTION), "value": F.col("counts")})
    stats = materialise(contacts.pair_stats(placed), "pair-stats")
    return contacts.drop_zero_pairs(raw, stats)


@query(
    "b6_drop_small_chroms",
    build(
        """SELECT c.accession, c.chrom AS chrom1, c.row, c.col, c.value FROM cis c
        SEMI JOIN (SELECT * FROM dims WHERE n_rows >= 399 AND n_cols >= 399) b ON c.accession = b.accession AND c.chrom = b.chrom"""
    ),
)
def drop_small_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cis = ft.cis(spark, sf_dir)
    dims = materialise(contacts.matrix_dims(cis), "dims")
    return _cell_view(contacts.drop_small_chroms(cis, dims, 399, 399), "accession", "chrom1")


@query("b7_region_bins", build("SELECT bedpe_idx, rs, re, cs, ce FROM regions"))
def region_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = regions.region_bins(fixture(spark, sf_dir, "fx_regions"), RESOLUTION)
    return binned.select("bedpe_idx", "rs", "re", "cs", "ce")


@query("b8_valid_regions", build("SELECT accession, bedpe_idx, chrom, rs, cs FROM valid"))
def valid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.window_job(spark, sf_dir).valid.select("accession", "bedpe_idx", "chrom", "rs", "cs")


@query(
    "b8_skipped_regions",
    build(
        """SELECT a.accession, r.bedpe_idx, r.chrom, r.rs, r.cs, CASE WHEN b.n_rows IS NULL THEN 'chrom' ELSE 'start' END AS reason
        FROM (SELECT DISTINCT accession FROM big) a CROSS JOIN regions r
        LEFT JOIN big b ON a.accession = b.accession AND r.chrom = b.chrom
        WHERE b.n_rows IS NULL OR r.rs >= b.n_rows OR r.cs >= b.n_cols"""
    ),
)
def skipped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = ft.window_job(spark, sf_dir)
    return regions.skipped_regions(job.binned, job.dims).select("accession", "bedpe_idx", "chrom", "rs", "cs", "reason")


@query(
    "b9_region_index",
    build(
        """SELECT accession, bedpe_idx, least(re, n_rows) AS re_clamped, least(ce, n_cols) AS ce_clamped,
           (cs + least(ce, n_cols)) // 2 AS mid, flip FROM valid"""
    ),
)
def region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = ft.window_job(spark, sf_dir)
    indexed = regions.region_index(job.binned, job.dims)
    return indexed.select(
        "accession",
        "bedpe_idx",
        F.col("re_clamped").cast("bigint").alias("re_clamped"),
        F.col("ce_clamped").cast("bigint").alias("ce_clamped"),
        "mid",
        "flip",
    )


@query("b10_strand_flip", build("SELECT accession, submat_key, row, col, value FROM cells"))
def strand_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_view(windows.with_key(ft.cells(spark, sf_dir)), "accession", "submat_key")


@query(
    "b11_genomic_split",
    build(
        """SELECT gene_idx, CASE WHEN chrom = 'chr4' THEN 'val' WHEN chrom IN ('chr5', 'chr11', 'chr14') THEN 'test' ELSE 'train' END AS seq_split
        FROM fx_genes"""
    ),
)
def genomic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = fixture(spark, sf_dir, "fx_genes")
    return genes.select("gene_idx", names.genomic_split(F.col("chrom")).alias("seq_split"))


@query("b12_organism_filter", build("SELECT rna_accession, hic_accession FROM fx_pairs WHERE organism = 'human'"))
def organism_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.organism_filter(fixture(spark, sf_dir, "fx_pairs")).drop("organism")


@query("b13_in_window_mask", build("SELECT accession, submat_key, row, col, value FROM cells WHERE row BETWEEN 0 AND 11 AND col BETWEEN 0 AND 39"))
def in_window_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_view(windows.unpack_windows(ft.records(spark, sf_dir), 12, 40), "accession", "submat_key")


@query("b14_submat_key", build("SELECT bedpe_idx, submat_key, chrom, rs, cs FROM regions"))
def submat_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = regions.window_regions(fixture(spark, sf_dir, "fx_regions"), RESOLUTION)
    parsed = names.parse_submat_key(F.col("submat_key"))
    return binned.select("bedpe_idx", "submat_key", *[c.alias(n) for n, c in parsed.items()])


@query(
    "b15_biosample_from_path",
    """SELECT page_id, CASE WHEN base LIKE '%.%' THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS biosample
    FROM (SELECT page_id, split_part(url, '/', -1) AS base FROM pages)""",
)
def biosample_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.biosample_from_path(F.col("url")).alias("biosample"))


@query(
    "b16_meta_columns",
    build(
        """SELECT a.bio_idx, a.bedpe_idx, a.accession, r.chrom, r.rs, r.cs, f.start1, f.end1, CAST(a.is_empty AS BIGINT) AS is_empty
        FROM assembled a JOIN regions r ON a.bedpe_idx = r.bedpe_idx JOIN fx_regions f ON a.bedpe_idx = f.bedpe_idx"""
    ),
)
def meta_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bedpe = fixture(spark, sf_dir, "fx_regions")
    return windows.item_meta(ft.assembled(spark, sf_dir), bedpe)


@query(
    "b16_target_meta",
    build("SELECT target_idx, submat_key, r0, r1, c0, c1, gene_symbol, enhancer_id AS element_id, CAST(regulated AS BIGINT) AS regulated FROM fx_targets"),
)
def target_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.target_meta(fixture(spark, sf_dir, "fx_targets"))


# Joins.


@query("j1_extract_windows", build("SELECT accession, submat_key, row, col, value, flip FROM raw_cells"))
def extract_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = ft.window_job(spark, sf_dir)
    found = windows.extract_windows(
        contacts.symmetrise(job.kept), windows.distinct_windows(job.binned), HEIGHT, WIDTH
    )
    return _cell_view(windows.with_key(found), "accession", "submat_key", "flip")


@query("j2_assemble", build("SELECT bio_idx, bedpe_idx, accession, submat_key, nnz, is_empty, CAST(total_count AS DOUBLE) AS total_count FROM assembled"))
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.assembled(spark, sf_dir).select(
        "bio_idx", "bedpe_idx", "accession", "submat_key", F.size("data").cast("bigint").alias("nnz"), "is_empty", "total_count"
    )


@query("j3_label_join", build("SELECT accession, gene_idx, gene_id, seq_split, round(y, 6) + 0.0::DOUBLE AS y FROM labels_long"))
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.labels_long(spark, sf_dir).withColumn("y", F.round("y", 6))


@query("j4_rna_to_hic", build("SELECT accession, gene_id, tpm FROM mapped"))
def rna_to_hic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "fx_pairs").where("organism = 'human'")
    return labels.rna_to_hic(fixture(spark, sf_dir, "fx_expr"), pairs).select("accession", "gene_id", "tpm")


@query(
    "j5_training_rows",
    build(
        """SELECT h.b, h.m, CAST(d AS BIGINT) AS d, round(CAST(h.vec[d + 1] AS DOUBLE), 6) + 0.0::DOUBLE AS hic_v,
           round(CAST(s.vec[d + 1] AS DOUBLE), 6) + 0.0::DOUBLE AS seq_v, y.y, w.w
        FROM fx_emb h JOIN fx_emb s ON h.m = s.m JOIN fx_y y ON h.b = y.b AND h.m = y.m JOIN fx_weights w ON h.m = w.m, generate_series(0, 63) AS g(d)"""
    ),
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = fixture(spark, sf_dir, "fx_emb")
    seq, y = emb.select("m", "vec"), fixture(spark, sf_dir, "fx_y")
    fusion.check_training_shapes(emb, seq, y)
    rows = fusion.training_rows(emb, seq, y, fixture(spark, sf_dir, "fx_weights"))
    values = rows.select("b", "m", F.posexplode(F.arrays_zip("hic_vec", "seq_vec")).alias("d", "v"), "y", "w")
    return values.select(
        "b",
        "m",
        F.col("d").cast("bigint").alias("d"),
        F.round(F.col("v.hic_vec").cast("double"), 6).alias("hic_v"),
        F.round(F.col("v.seq_vec").cast("double"), 6).alias("seq_v"),
        "y",
        "w",
    )


@query(
    "j6_perturbation_pairs",
    build(
        """SELECT a.accession, a.target_idx, a.submat_key, s.nnz, s.is_empty, t.token_text FROM asked a
        JOIN win_stats s ON a.accession = s.accession AND a.submat_key = s.submat_key JOIN tokens t ON a.seq_row = t.region_idx""",
        bed_source="fx_region_bed",
    ),
)
def perturbation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.target_pairs(spark, sf_dir, with_tokens=True, arrays=False).select(
        "accession", "target_idx", "submat_key", F.col("data").cast("bigint").alias("nnz"), "is_empty", "token_text"
    )


@query(
    "j6_unknown_windows",
    build(
        """SELECT a.accession, t.target_idx, t.submat_key FROM fx_targets t CROSS JOIN (SELECT DISTINCT accession FROM keys) a
        WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.accession = a.accession AND k.submat_key = t.submat_key)"""
    ),
)
def unknown_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(ft.records(spark, sf_dir).select("accession", "submat_key"), "records")
    return perturb.unknown_windows(fixture(spark, sf_dir, "fx_targets"), stored)


@query(
    "j7_expected_fill",
    build(
        """SELECT c.accession, c.submat_key, c.row, c.col, least(abs(c.col - c.row - 32), 47) AS k, round(e.value, 6) + 0.0::DOUBLE AS expected
        FROM cells c JOIN fx_k_median e ON e.k = least(abs(c.col - c.row - 32), 47)"""
    ),
)
def expected_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = materialise(fixture(spark, sf_dir, "fx_k_median"), "bands")
    filled = perturb.expected_fill(windows.with_key(ft.cells(spark, sf_dir)), bands, OFFSET, BANDS)
    placed = [F.col(c).cast("bigint").alias(c) for c in ("row", "col")]
    return filled.select("accession", "submat_key", *placed, "k", F.round("expected", 6).alias("expected"))


@query("j8_fetch_sequences", build("SELECT region_idx, chrom, token_text FROM tokens", bed_source="fx_bed"))
def fetch_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.bed_tokens(spark, sf_dir).select("region_idx", "chrom", "token_text")


@query(
    "j9_seq_by_region",
    build("SELECT r.bedpe_idx, r.chr1, r.start1, t.token_text FROM fx_regions r JOIN tokens t ON r.bedpe_idx = t.region_idx", bed_source="fx_region_bed"),
)
def seq_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    bedpe = fixture(spark, sf_dir, "fx_regions").select("bedpe_idx", "chr1", "start1")
    return ft.region_tokens(spark, sf_dir, bedpe)


@query(
    "j10_attach_predictions",
    build("SELECT target_idx, submat_key, gene_symbol, CAST(c0 AS DOUBLE) / 8 AS y_orig, CAST(c1 AS DOUBLE) / 4 AS y_pert FROM fx_targets"),
)
def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = fixture(spark, sf_dir, "fx_targets")
    preds = targets.select("target_idx", (F.col("c0") / 8.0).alias("y_orig"), (F.col("c1") / 4.0).alias("y_pert"))
    return perturb.attach_predictions(targets.select("target_idx", "submat_key", "gene_symbol"), preds)


@query(
    "j11_biosample_split_join",
    build("SELECT seq_split, bio_split, bio_idx, gene_idx, round(CAST(y AS DOUBLE), 4) + 0.0::DOUBLE AS y, is_missing FROM labels_split"),
)
def biosample_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.label_view(ft.labels_split(spark, sf_dir))


@query(
    "j12_empty_windows",
    build(
        """SELECT v.accession, v.bedpe_idx, v.chrom, v.rs, v.cs FROM valid v
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.accession = v.accession AND s.submat_key = v.submat_key)"""
    ),
)
def empty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.empty(spark, sf_dir)


@query(
    "j13_impute_from_nearest",
    build(
        """SELECT n.test AS accession, n.train AS source, l.gene_idx, round(l.y / 2, 6) + 0.0::DOUBLE AS y_hat FROM (
             SELECT a.accession AS test, arg_min(b.accession, (-b.r, b.accession)) AS train FROM (SELECT DISTINCT accession FROM labels_long WHERE accession IN (SELECT accession FROM fx_bio_split WHERE split = 'test')) a
             JOIN sims b ON a.accession = b.test GROUP BY a.accession) n
           JOIN labels_long l ON l.accession = n.train""",
        sims="""(SELECT t.accession AS test, r.accession, corr(t.y, r.y) AS r FROM labels_long t JOIN labels_long r ON t.gene_idx = r.gene_idx
                 WHERE r.accession IN (SELECT accession FROM fx_bio_split WHERE split = 'train') GROUP BY t.accession, r.accession)""",
    ),
)
def impute_from_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = materialise(ft.labels_long(spark, sf_dir), "labels")
    splits = fixture(spark, sf_dir, "fx_bio_split")
    preds = expr.select("accession", "gene_idx", (F.col("y") / 2).alias("y_hat"))
    imputed = metrics.impute_from_nearest(expr, preds, splits.where("split = 'test'"), splits.where("split = 'train'"))
    return imputed.withColumn("y_hat", F.round("y_hat", 6))


# Aggregations.


@query(
    "d1_matrix_dims",
    build(
        """SELECT accession, chrom1, chrom2,
           CASE WHEN chrom1 = chrom2 THEN greatest(max(pos1 // 1000), max(pos2 // 1000)) ELSE max(pos1 // 1000) END + 1 AS n_rows,
           CASE WHEN chrom1 = chrom2 THEN greatest(max(pos1 // 1000), max(pos2 // 1000)) ELSE max(pos2 // 1000) END + 1 AS n_cols
        FROM fx_contacts GROUP BY accession, chrom1, chrom2"""
    ),
)
def matrix_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = contacts.matrix_dims(contacts.bin_contacts(fixture(spark, sf_dir, "fx_contacts"), RESOLUTION))
    return dims.withColumns({c: F.col(c).cast("bigint") for c in ("n_rows", "n_cols")})


@query("d2_total_count", build("SELECT accession, CAST(total_count AS DOUBLE) AS total_count FROM totals"))
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.total_count(ft.cis(spark, sf_dir), HEIGHT, WIDTH)


@query("d3_symmetrise", build("SELECT accession, chrom, row, col, value FROM sym"))
def symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_view(contacts.symmetrise(ft.window_job(spark, sf_dir).kept), "accession", "chrom")


@query("d4_window_stats", build("SELECT accession, submat_key, nnz, CAST(total AS DOUBLE) AS total, is_empty FROM win_stats"))
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = ft.window_job(spark, sf_dir)
    return windows.window_stats(job.valid, job.cells)


@query("d5_window_max", build("SELECT accession, submat_key, round(top, 6) + 0.0::DOUBLE AS window_max FROM stored"))
def window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = windows.with_key(image.window_max(ft.cells(spark, sf_dir)))
    return top.withColumn("window_max", F.round("window_max", 6))


@query("d6_last_wins", build("SELECT submat_key, chrom, rs, cs, flip FROM wins"))
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = regions.window_regions(fixture(spark, sf_dir, "fx_regions"), RESOLUTION)
    return windows.distinct_windows(binned).drop("bedpe_idx")


@query(
    "d7_pack_windows",
    build(
        """SELECT accession, submat_key, string_agg(row || ':' || col || ':' || CAST(value AS BIGINT), ' ' ORDER BY row, col) AS packed
        FROM cells GROUP BY accession, submat_key"""
    ),
)
def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = windows.pack_windows(ft.cells(spark, sf_dir), ordered=True)
    entry = F.transform(
        F.arrays_zip("row", "col", "data"),
        lambda e: F.concat_ws(":", e["row"].cast("string"), e["col"].cast("string"), e["data"].cast("bigint").cast("string")),
    )
    return packed.select("accession", "submat_key", F.array_join(entry, " ").alias("packed"))


@query("d8_genes_in_all_files", build("SELECT gene_id FROM common"))
def genes_in_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "fx_pairs").where("organism = 'human'")
    return labels.genes_in_all_files(labels.rna_to_hic(fixture(spark, sf_dir, "fx_expr"), pairs))


@query(
    "d9_label_matrix",
    build(
        """SELECT seq_split, bio_split, bio_idx, pos // 32 AS block, min(pos) AS first, CAST(count(*) AS BIGINT) AS n,
           round(sum(CAST(CAST(y AS FLOAT) AS DOUBLE) * (pos % 32 + 1)), 3) + 0.0::DOUBLE AS weighted
        FROM (SELECT *, dense_rank() OVER (PARTITION BY seq_split ORDER BY gene_idx) - 1 AS pos FROM labels_split)
        GROUP BY seq_split, bio_split, bio_idx, pos // 32"""
    ),
)
def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = labels.label_matrix(materialise(ft.labels_split(spark, sf_dir), "labels"), block=32)
    placed = F.transform("values", lambda v, i: v.cast("double") * (i + 1))
    weighted = F.aggregate(placed, F.lit(0.0), lambda acc, x: acc + x)
    return matrix.select(
        "seq_split", "bio_split", "bio_idx", "block", "first", F.size("values").cast("bigint").alias("n"), F.round(weighted, 3).alias("weighted")
    )


@query(
    "d9_split_sizes",
    build("SELECT seq_split, bio_split, count(DISTINCT bio_idx) AS n_bios, count(DISTINCT gene_idx) AS n_seqs FROM labels_split GROUP BY seq_split, bio_split"),
)
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.split_sizes(ft.labels_split(spark, sf_dir))


@query("d10_nan_guard", build("SELECT accession, gene_id, tpm FROM mapped"))
def nan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "fx_pairs").where("organism = 'human'")
    mapped = labels.rna_to_hic(fixture(spark, sf_dir, "fx_expr"), pairs)
    return labels.nan_guard(mapped, "tpm").select("accession", "gene_id", "tpm")


@query(
    "d11_densify",
    build(
        """SELECT k.accession, k.submat_key, CAST(g.i AS BIGINT) AS i, coalesce(c.value, 0) AS value
        FROM keys k CROSS JOIN (SELECT unnest(generate_series(0, 1279)) AS i) g
        LEFT JOIN cells c ON k.accession = c.accession AND k.submat_key = c.submat_key AND c.row * 80 + c.col = g.i"""
    ),
)
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = image.densify(ft.records(spark, sf_dir), HEIGHT, WIDTH)
    return dense.select("accession", "submat_key", F.posexplode("dense").alias("i", "value")).select(
        "accession", "submat_key", F.col("i").cast("bigint").alias("i"), F.col("value").cast("double").alias("value")
    )


@query(
    "d11_sum_duplicates",
    build("SELECT accession, chrom AS chrom1, row, col, sum(value) AS value FROM cis GROUP BY accession, chrom, row, col"),
)
def sum_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_view(image.sum_duplicates(ft.cis(spark, sf_dir), ("accession", "chrom1")), "accession", "chrom1")


@query("d12_mse", build("SELECT accession, round(avg(pow(y_hat - y, 2)), 6) + 0.0::DOUBLE AS mse FROM fx_scores GROUP BY accession"))
def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mse(fixture(spark, sf_dir, "fx_scores"), ["accession"]).withColumn("mse", F.round("mse", 6))


@query("d13_pearson_by_biosample", build("SELECT accession, round(corr(y_hat, y), 6) + 0.0::DOUBLE AS pearson FROM fx_scores GROUP BY accession"))
def pearson_by_biosample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pearson(fixture(spark, sf_dir, "fx_scores")).withColumn("pearson", F.round("pearson", 6))


@query("d13_pearson_flat", build("SELECT round(corr(y_hat, y), 6) + 0.0::DOUBLE AS pearson FROM fx_scores"))
def pearson_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pearson(fixture(spark, sf_dir, "fx_scores"), ()).withColumn("pearson", F.round("pearson", 6))


RANKED = """(SELECT accession,
    rank() OVER (PARTITION BY accession ORDER BY y) + (count(*) OVER (PARTITION BY accession, y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY accession ORDER BY y_hat) + (count(*) OVER (PARTITION BY accession, y_hat) - 1) / 2.0::DOUBLE AS rh
    FROM fx_scores)"""


@query("d14_spearman_by_biosample", build("SELECT accession, round(corr(rh, ry), 6) + 0.0::DOUBLE AS spearman FROM ranked GROUP BY accession", ranked=RANKED))
def spearman_by_biosample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(fixture(spark, sf_dir, "fx_scores")).withColumn("spearman", F.round("spearman", 6))


@query(
    "d14_spearman_flat",
    build(
        "SELECT round(corr(rh, ry), 6) + 0.0::DOUBLE AS spearman FROM ranked",
        ranked=RANKED.replace("PARTITION BY accession, ", "PARTITION BY ").replace("PARTITION BY accession ", ""),
    ),
)
def spearman_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(fixture(spark, sf_dir, "fx_scores"), ()).withColumn("spearman", F.round("spearman", 6))


HALF_RANKED = RANKED.replace("FROM fx_scores", "FROM fx_half_scores WHERE y IS NOT NULL AND y_hat IS NOT NULL")


@query("d13_pearson_incomplete", build("SELECT accession, round(corr(y_hat, y), 6) + 0.0::DOUBLE AS pearson FROM fx_half_scores GROUP BY accession"))
def pearson_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pearson(fixture(spark, sf_dir, "fx_half_scores")).withColumn("pearson", F.round("pearson", 6))


@query(
    "d14_spearman_incomplete",
    build("SELECT accession, round(corr(rh, ry), 6) + 0.0::DOUBLE AS spearman FROM half_ranked GROUP BY accession", half_ranked=HALF_RANKED),
)
def spearman_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(fixture(spark, sf_dir, "fx_half_scores")).withColumn("spearman", F.round("spearman", 6))


@query(
    "d14_mean_spearman",
    build("SELECT round(avg(r), 6) + 0.0::DOUBLE AS mean_spearman FROM (SELECT corr(rh, ry) AS r FROM ranked GROUP BY accession)", ranked=RANKED),
)
def mean_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_key = metrics.spearman(fixture(spark, sf_dir, "fx_scores"))
    return metrics.mean_score(per_key, "spearman").withColumn("mean_spearman", F.round("mean_spearman", 6))


@query("d14_mean_scores", build("SELECT round(avg(r), 6) + 0.0::DOUBLE AS mean_pearson FROM (SELECT corr(y_hat, y) AS r FROM fx_scores GROUP BY accession)"))
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_key = metrics.pearson(fixture(spark, sf_dir, "fx_scores"))
    return metrics.mean_score(per_key, "pearson").withColumn("mean_pearson", F.round("mean_pearson", 6))


@query("d15_mean_pool", build("SELECT m, CAST(d AS BIGINT) AS d, round(avg(v), 6) + 0.0::DOUBLE AS v FROM seq_bins GROUP BY m, d"))
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = fusion.mean_pool(fusion.seq_bins(fixture(spark, sf_dir, "fx_emb"), 8), ["m"])
    return ft.vector_view(pooled, "m")


@query(
    "d16_store_dims",
    build(
        """SELECT max(r) + 1 AS n_rows, max(c) + 1 AS n_cols, max(d) + 1 AS dim,
           CAST(ceil(count(DISTINCT (b, m)) / 64.0::DOUBLE) AS BIGINT) AS steps FROM grid"""
    ),
)
def store_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.store_dims(fusion.grid_cells(fixture(spark, sf_dir, "fx_emb"), 4, 8), 64)


# Orderings.


@query(
    "w1_average_rank",
    build(
        """SELECT DISTINCT accession, y_hat,
           rank() OVER (PARTITION BY accession ORDER BY y_hat) + (count(*) OVER (PARTITION BY accession, y_hat) - 1) / 2.0::DOUBLE AS rank FROM fx_scores"""
    ),
)
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_rank(fixture(spark, sf_dir, "fx_scores"), ["accession"], "y_hat")


@query(
    "w2_ordinal",
    build("SELECT chrom, gene_idx, row_number() OVER (PARTITION BY chrom ORDER BY gene_idx) - 1 AS pos FROM fx_genes"),
)
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.ordinal(fixture(spark, sf_dir, "fx_genes"), ["chrom"], "gene_idx", "pos")


@query(
    "w3_last_by_order",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
)
def last_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return regions.last_wins(orders, ["o_custkey"], "o_orderkey")


@query(
    "w4_biosample_major_order",
    build(
        """SELECT row_number() OVER (ORDER BY bio_idx, bedpe_idx) - 1 AS flat, accession, submat_key FROM assembled"""
    ),
)
def biosample_major_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = materialise(regions.window_regions(fixture(spark, sf_dir, "fx_regions"), RESOLUTION), "regions")
    pairs = skew.pair_all(fixture(spark, sf_dir, "fx_biosamples"), binned, order="bio_idx")
    flat = numeric.flat_index(F.col("bio_idx"), F.col("bedpe_idx"), binned.count())
    return pairs.select(flat.alias("flat"), "accession", "submat_key").orderBy("flat")


@query(
    "w5_best_run",
    build(
        """SELECT accession, round(mse, 6) + 0.0::DOUBLE AS val_loss FROM (SELECT accession, avg(pow(y_hat - y, 2)) AS mse FROM fx_scores GROUP BY accession)
        ORDER BY mse LIMIT 1"""
    ),
)
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = metrics.mse(fixture(spark, sf_dir, "fx_scores"), ["accession"]).withColumnRenamed("mse", "val_loss")
    return metrics.best_run(runs).withColumn("val_loss", F.round("val_loss", 6))
