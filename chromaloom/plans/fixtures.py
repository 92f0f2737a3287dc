"""Input tables of the engine, derived from the given tables.

Each definition is plain SQL that reads the same in Spark and DuckDB; ``{name}`` stands for a table.
Window geometry is scaled: resolution 1000, 16 x 80 bins, own diagonal at offset 32, 48 distance bands.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RESOLUTION = 1000
HEIGHT = 16
WIDTH = 80
OFFSET = 32
BANDS = 48
CONTEXT = 128

DEFINITIONS: dict[str, str] = {
    # Bare and prefixed names, unplaced contigs, trans pairs, diagonal and repeated cells.
    "fx_contacts": """
        SELECT concat('ENCFF00', CAST(l_orderkey % 3 AS STRING)) AS accession,
               CASE WHEN l_quantity >= 46 THEN '1'
                    WHEN l_linenumber = 6 THEN 'chrUn_a' WHEN l_linenumber = 7 THEN 'chr7_random'
                    WHEN l_linenumber = 2 THEN 'chr2' ELSE CAST(l_linenumber AS STRING) END AS chrom1,
               CASE WHEN l_linenumber = 6 THEN 'chrUn_a' WHEN l_linenumber = 7 THEN 'chr7_random'
                    WHEN l_linenumber = 2 THEN 'chr2' ELSE CAST(l_linenumber AS STRING) END AS chrom2,
               CAST(least(l_partkey % 400, (l_suppkey * 7) % 400) * 1000 + l_orderkey % 1000 AS BIGINT) AS pos1,
               CAST(greatest(l_partkey % 400, (l_suppkey * 7) % 400) * 1000 + (l_orderkey * 13) % 1000 AS BIGINT) AS pos2,
               l_quantity AS counts
        FROM {lineitem}""",
    # BEDPE rows with unknown chromosomes, starts out of range, truncated windows and repeated keys.
    "fx_regions": """
        SELECT p_partkey AS bedpe_idx, concat('chr', CAST(p_size % 8 + 1 AS STRING)) AS chr1,
               (p_partkey * 37 % 420) * 1000 AS start1, (p_partkey * 37 % 420) * 1000 + 16000 AS end1,
               concat('chr', CAST(p_size % 8 + 1 AS STRING)) AS chr2,
               greatest((p_partkey * 37 % 420) * 1000 - 32000, 0) AS start2,
               greatest((p_partkey * 37 % 420) * 1000 - 32000, 0) + 80000 AS end2,
               p_name AS name, CAST(0 AS BIGINT) AS score,
               CASE WHEN p_brand IN ('Brand#11', 'Brand#13') OR p_partkey % 2 = 1 THEN '-' ELSE '+' END AS strand1,
               '.' AS strand2
        FROM {part}""",
    # One TPM per assay and gene. The 'view' assay reports nothing below its detection limit, and a gene
    # that some assay lacks is dropped by the all-files rule.
    "fx_expr": """
        SELECT concat('ENCRNA_', event_type) AS rna_accession,
               concat('G', CAST(user_id AS STRING)) AS gene_id, max(value) AS tpm
        FROM {events} GROUP BY event_type, user_id
        HAVING NOT (event_type = 'view' AND max(value) < 60)""",
    "fx_pairs": """
        SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'mouse' ELSE 'human' END AS organism,
               concat('ENCRNA_', event_type) AS rna_accession,
               concat('ENCHIC_', event_type) AS hic_accession
        FROM {events}""",
    "fx_genes": """
        SELECT c_custkey AS gene_idx, concat('G', CAST(c_custkey AS STRING)) AS gene_id,
               concat('chr', CAST(c_custkey % 22 + 1 AS STRING)) AS chrom
        FROM {customer}""",
    # 'ENCHIC_ghost' is listed without expression, so its labels are zero.
    "fx_bio_split": """
        SELECT DISTINCT CASE event_type WHEN 'purchase' THEN 'val' WHEN 'signup' THEN 'test' ELSE 'train' END AS split,
               CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS BIGINT) AS bio_idx,
               CASE event_type WHEN 'error' THEN 'ENCHIC_ghost' ELSE concat('ENCHIC_', event_type) END AS accession
        FROM {events}""",
    # Any letter besides ACGT counts as other; line breaks and '>' have no place in a sequence line.
    "fx_contigs": """
        SELECT concat('chr', CAST(doc_id AS STRING)) AS chrom,
               replace(replace(replace(text, chr(10), 'N'), chr(13), 'N'), '>', 'N') AS seq
        FROM {documents} WHERE length(text) > 0""",
    "fx_bed": """
        SELECT doc_id AS region_idx, concat('chr', CAST(doc_id AS STRING)) AS chrom,
               (doc_id * 31) % 200 - 20 AS start_bp, (doc_id * 31) % 200 + 44 AS end_bp,
               CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM {documents}""",
    # 64 values: 8 bins of 8 (sequence) or a 2 x 4 grid of 8 (contact).
    "fx_emb": """
        SELECT vec_id AS m, CAST(label AS BIGINT) AS b, embedding AS vec FROM {embeddings}""",
    "fx_weights": """
        SELECT vec_id AS m, CAST(label + 1 AS DOUBLE) / 8 AS w FROM {embeddings}""",
    "fx_y": """
        SELECT vec_id AS m, CAST(label AS BIGINT) AS b, CAST(vec_id % 7 AS DOUBLE) / 2 AS y FROM {embeddings}""",
    # Listed biosamples; the last one has no contacts.
    "fx_biosamples": """
        SELECT DISTINCT l_orderkey % 4 AS bio_idx, concat('ENCFF00', CAST(l_orderkey % 4 AS STRING)) AS accession
        FROM {lineitem}""",
    # A sequence interval for each region row.
    "fx_region_bed": """
        SELECT p_partkey AS region_idx,
               concat('chr', CAST(p_partkey % (SELECT count(*) FROM {documents}) AS STRING)) AS chrom,
               (p_partkey * 31) % 200 - 20 AS start_bp, (p_partkey * 31) % 200 + 44 AS end_bp,
               CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM {part}""",
    # Blocks in window coordinates, one per region row.
    "fx_targets": """
        SELECT p_partkey AS target_idx,
               concat('chr', CAST(p_size % 8 + 1 AS STRING), ':', CAST(p_partkey * 37 % 420 AS STRING), ',',
                      CAST(greatest(p_partkey * 37 % 420 - 32, 0) AS STRING)) AS submat_key,
               CAST(0 AS BIGINT) AS r0, CAST(16 AS BIGINT) AS r1,
               p_partkey % 70 AS c0, p_partkey % 70 + 5 AS c1, p_partkey AS seq_row,
               p_name AS gene_symbol, concat('E', CAST(p_partkey AS STRING)) AS enhancer_id,
               CAST(p_partkey % 2 AS INT) AS regulated
        FROM {part}""",
    # Mean count by distance from the diagonal, the last band taking all further ones.
    "fx_k_median": """
        SELECT CAST(least(abs(l_partkey % 400 - (l_suppkey * 7) % 400), 47) AS BIGINT) AS k, avg(l_quantity) AS value
        FROM {lineitem} GROUP BY least(abs(l_partkey % 400 - (l_suppkey * 7) % 400), 47)""",
    # Prediction and truth with ties.
    "fx_scores": """
        SELECT event_type AS accession, event_id AS gene_idx, log2(value + 1) AS y,
               CAST(user_id % 10 AS DOUBLE) + floor(value / 20) AS y_hat
        FROM {events}""",
    # The same with gaps on either side.
    "fx_half_scores": """
        SELECT event_type AS accession, event_id AS gene_idx, CASE WHEN event_id % 11 <> 3 THEN log2(value + 1) END AS y,
               CASE WHEN event_id % 13 <> 5 THEN CAST(user_id % 10 AS DOUBLE) + floor(value / 20) END AS y_hat
        FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = DEFINITIONS[name]
    inputs = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **inputs)


def fixture_sql(name: str) -> str:
    """The same definition over DuckDB views."""
    return re.sub(r"\{(\w+)\}", r"\1", DEFINITIONS[name])
