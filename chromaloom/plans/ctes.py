"""Common table expressions of the SQL counterparts (DuckDB).

They restate each step straightforwardly: range joins instead of tiles, windows instead of aggregates.
"""

from __future__ import annotations

import re

from chromaloom.plans.fixtures import DEFINITIONS, fixture_sql

STEPS: dict[str, str] = {
    "placed": """
        SELECT * FROM fx_contacts
        WHERE NOT (lower(chrom1) LIKE '%all%' OR lower(chrom1) LIKE '%random%' OR lower(chrom1) LIKE '%alt%' OR chrom1 LIKE '%Un%')
          AND NOT (lower(chrom2) LIKE '%all%' OR lower(chrom2) LIKE '%random%' OR lower(chrom2) LIKE '%alt%' OR chrom2 LIKE '%Un%')""",
    "cis": """
        SELECT accession, CASE WHEN chrom1 LIKE 'chr%' THEN chrom1 ELSE 'chr' || chrom1 END AS chrom,
               CAST(floor(pos1 / 1000.0::DOUBLE) AS BIGINT) AS row, CAST(floor(pos2 / 1000.0::DOUBLE) AS BIGINT) AS col,
               CAST(counts AS DOUBLE) AS value
        FROM placed WHERE chrom1 = chrom2""",
    "dims": """
        SELECT accession, chrom, greatest(max(row), max(col)) + 1 AS n_rows, greatest(max(row), max(col)) + 1 AS n_cols
        FROM cis GROUP BY accession, chrom HAVING sum(value) <> 0""",
    "big": "SELECT * FROM dims WHERE n_rows >= 16 AND n_cols >= 80",
    "kept": "SELECT c.* FROM cis c SEMI JOIN big b ON c.accession = b.accession AND c.chrom = b.chrom",
    "totals": """
        SELECT a.accession, coalesce(t.total_count, 0.0::DOUBLE) AS total_count
        FROM (SELECT DISTINCT accession FROM cis) a
        LEFT JOIN (SELECT accession, sum(value) AS total_count FROM kept GROUP BY accession) t ON a.accession = t.accession""",
    "mirrored": """
        SELECT accession, chrom, row, col, CASE WHEN row = col THEN value / 2 ELSE value END AS value FROM kept
        UNION ALL
        SELECT accession, chrom, col AS row, row AS col, CASE WHEN row = col THEN value / 2 ELSE value END AS value FROM kept""",
    "sym": "SELECT accession, chrom, row, col, sum(value) AS value FROM mirrored GROUP BY accession, chrom, row, col",
    "regions": """
        SELECT bedpe_idx, chr1 AS chrom, CAST(floor(start1 / 1000.0::DOUBLE) AS BIGINT) AS rs, CAST(floor(end1 / 1000.0::DOUBLE) AS BIGINT) AS re,
               CAST(floor(start2 / 1000.0::DOUBLE) AS BIGINT) AS cs, CAST(floor(end2 / 1000.0::DOUBLE) AS BIGINT) AS ce,
               strand1 = '-' AS flip,
               chr1 || ':' || CAST(CAST(floor(start1 / 1000.0::DOUBLE) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(start2 / 1000.0::DOUBLE) AS BIGINT) AS VARCHAR) AS submat_key
        FROM fx_regions""",
    "valid": """
        SELECT b.accession, b.n_rows, b.n_cols, r.* FROM regions r JOIN big b ON r.chrom = b.chrom
        WHERE r.rs < b.n_rows AND r.cs < b.n_cols""",
    "wins": """
        SELECT submat_key, chrom, rs, cs, flip FROM (
          SELECT *, row_number() OVER (PARTITION BY submat_key ORDER BY bedpe_idx DESC) AS rn FROM regions) WHERE rn = 1""",
    "raw_cells": """
        SELECT s.accession, w.submat_key, s.row - w.rs AS row, s.col - w.cs AS col, s.value, w.flip
        FROM sym s JOIN wins w ON s.chrom = w.chrom AND s.row >= w.rs AND s.row < w.rs + 16 AND s.col >= w.cs AND s.col < w.cs + 80""",
    "cells": """
        SELECT accession, submat_key, CASE WHEN flip THEN 15 - row ELSE row END AS row,
               CASE WHEN flip THEN 79 - col ELSE col END AS col, value FROM raw_cells""",
    "keys": "SELECT DISTINCT accession, submat_key FROM valid",
    "stored": """
        SELECT accession, submat_key, count(*) AS nnz, sum(value) AS total, greatest(max(log10(value + 1)), 0) AS top
        FROM cells GROUP BY accession, submat_key""",
    "win_stats": """
        SELECT k.accession, k.submat_key, coalesce(s.nnz, 0) AS nnz, coalesce(s.total, 0) AS total,
               s.nnz IS NULL AS is_empty, coalesce(s.top, 0) AS top, t.total_count
        FROM keys k LEFT JOIN stored s ON k.accession = s.accession AND k.submat_key = s.submat_key
        JOIN totals t ON k.accession = t.accession""",
    "assembled": """
        SELECT b.bio_idx, r.bedpe_idx, b.accession, r.submat_key, coalesce(w.nnz, 0) AS nnz,
               coalesce(w.is_empty, true) AS is_empty, coalesce(w.top, 0) AS top, coalesce(t.total_count, 0) AS total_count
        FROM fx_biosamples b CROSS JOIN regions r
        LEFT JOIN win_stats w ON b.accession = w.accession AND r.submat_key = w.submat_key
        LEFT JOIN totals t ON b.accession = t.accession""",
    # Expression labels.
    "mapped": """
        SELECT p.hic_accession AS accession, e.gene_id, e.tpm FROM fx_expr e
        JOIN fx_pairs p ON e.rna_accession = p.rna_accession WHERE p.organism = 'human'""",
    "common": """
        SELECT gene_id FROM mapped GROUP BY gene_id
        HAVING count(DISTINCT accession) = (SELECT count(DISTINCT accession) FROM mapped)""",
    "labels_long": """
        SELECT m.accession, g.gene_idx, m.gene_id,
               CASE WHEN g.chrom = 'chr4' THEN 'val' WHEN g.chrom IN ('chr5', 'chr11', 'chr14') THEN 'test' ELSE 'train' END AS seq_split,
               log2(m.tpm + 1) AS y
        FROM mapped m JOIN common c ON m.gene_id = c.gene_id JOIN fx_genes g ON m.gene_id = g.gene_id""",
    "labels_split": """
        SELECT g.seq_split, s.split AS bio_split, s.bio_idx, s.accession, g.gene_idx,
               coalesce(l.y, 0) AS y, l.y IS NULL AS is_missing
        FROM fx_bio_split s CROSS JOIN (SELECT DISTINCT gene_idx, seq_split FROM labels_long) g
        LEFT JOIN labels_long l ON s.accession = l.accession AND g.gene_idx = l.gene_idx""",
    # Sequences, 128 tokens per interval.
    "bed_wide": """
        SELECT b.region_idx, b.chrom, b.strand, b.start_bp - CAST(floor((128 - (b.end_bp - b.start_bp)) / 2.0::DOUBLE) AS BIGINT) AS s,
               c.seq, length(c.seq) AS len
        FROM bed_source b JOIN fx_contigs c ON b.chrom = c.chrom""",
    "bed_cut": """
        SELECT region_idx, chrom, strand, CAST(least(greatest(-s, 0), 128) AS INT) AS lp,
               CAST(greatest(least(s + 128, len) - greatest(s, 0), 0) AS INT) AS n,
               substr(seq, CAST(greatest(s, 0) + 1 AS BIGINT), greatest(least(s + 128, len) - greatest(s, 0), 0)) AS cut
        FROM bed_wide""",
    "bed_plus": """
        SELECT region_idx, chrom, strand,
               repeat('.', lp) || translate(regexp_replace(CASE WHEN n > 0 THEN cut ELSE '' END, '[^ACGTacgt]', '4', 'g'), 'ACGTacgt', '01230123')
               || repeat('.', 128 - lp - n) AS t
        FROM bed_cut""",
    "tokens": """
        SELECT region_idx, chrom, strand, CASE WHEN strand = '-' THEN reverse(translate(t, '0123', '3210')) ELSE t END AS token_text
        FROM bed_plus""",
    "freq": """
        SELECT region_idx, token_text,
               (128 - length(replace(token_text, '0', '')) + 0.25::DOUBLE * (128 - length(replace(token_text, '.', '')))) / 128 AS f0,
               (128 - length(replace(token_text, '1', '')) + 0.25::DOUBLE * (128 - length(replace(token_text, '.', '')))) / 128 AS f1,
               (128 - length(replace(token_text, '2', '')) + 0.25::DOUBLE * (128 - length(replace(token_text, '.', '')))) / 128 AS f2,
               (128 - length(replace(token_text, '3', '')) + 0.25::DOUBLE * (128 - length(replace(token_text, '.', '')))) / 128 AS f3
        FROM tokens""",
    # Images: stored cells and the mean of each normalised channel over the whole window.
    "rgb": """
        SELECT c.accession, c.submat_key, c.row, c.col, log10(c.value + 1) AS x, s.top,
               CASE WHEN s.top = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS red,
               CASE WHEN s.top = 0 THEN 0.0::DOUBLE ELSE (s.top - log10(c.value + 1)) / s.top END AS green
        FROM cells c JOIN stored s ON c.accession = s.accession AND c.submat_key = s.submat_key""",
    "fade_sums": "SELECT accession, submat_key, sum(green - 1) AS fade FROM rgb GROUP BY accession, submat_key",
    "channel_means": """
        SELECT a.bio_idx, a.bedpe_idx, a.accession, a.total_count,
               CASE WHEN a.is_empty OR a.top = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS red,
               CASE WHEN a.is_empty OR a.top = 0 THEN 0.0::DOUBLE ELSE 1 + f.fade / 1280 END AS green
        FROM assembled a LEFT JOIN fade_sums f ON a.accession = f.accession AND a.submat_key = f.submat_key""",
    # Perturbation: every target is asked of every accession whose store has its window.
    "asked": """
        SELECT k.accession, t.target_idx, t.submat_key, t.r0, t.r1, t.c0, t.c1, t.seq_row
        FROM fx_targets t JOIN keys k ON t.submat_key = k.submat_key""",
    "orig_cells": """
        SELECT a.accession, a.target_idx, c.row, c.col, c.value FROM asked a
        JOIN cells c ON a.accession = c.accession AND a.submat_key = c.submat_key""",
    "block": """
        SELECT a.accession, a.target_idx, r.i AS row, c.i AS col
        FROM asked a, generate_series(0, 15) AS r(i), generate_series(0, 79) AS c(i)
        WHERE r.i >= a.r0 AND r.i < a.r1 AND c.i >= a.c0 AND c.i < a.c1""",
    "outside": """
        SELECT o.* FROM orig_cells o JOIN asked a ON o.accession = a.accession AND o.target_idx = a.target_idx
        WHERE NOT (o.row >= a.r0 AND o.row < a.r1 AND o.col >= a.c0 AND o.col < a.c1)""",
    "pert_cells": """
        SELECT accession, target_idx, row, col, value FROM outside
        UNION ALL
        SELECT b.accession, b.target_idx, b.row, b.col, k.value FROM block b
        JOIN fx_k_median k ON k.k = least(abs(b.col - b.row - 32), 47)""",
    # Embeddings.
    "seq_bins": """
        SELECT m, i AS bin, d, CAST(vec[i * 8 + d + 1] AS DOUBLE) AS v
        FROM fx_emb, generate_series(0, 7) AS g(i), generate_series(0, 7) AS h(d)""",
    "grid": """
        SELECT b, m, r, c, d, CAST(vec[(r * 4 + c) * 8 + d + 1] AS DOUBLE) AS v
        FROM fx_emb, generate_series(0, 1) AS g(r), generate_series(0, 3) AS h(c), generate_series(0, 7) AS k(d)""",
}


def build(final: str, **alias: str) -> str:
    """Put the steps that ``final`` needs in front of it; ``alias`` names stand-ins for step inputs."""
    texts = {**{name: fixture_sql(name) for name in DEFINITIONS}, **STEPS}
    texts |= {name: f"SELECT * FROM {source}" for name, source in alias.items()}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", text)):
            if name in texts and name not in order and name not in pending:
                pending.append(name)
                need(texts[name])
                order.append(name)

    pending: list[str] = []
    need(final)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{name} AS ({texts[name]})" for name in order) + "\n" + final
