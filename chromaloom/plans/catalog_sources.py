"""Readers and writers: each query writes tables derived from the given ones and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.operators import balance, contacts, infer, perturb
from chromaloom.plans import features as ft
from chromaloom.plans import pipelines
from chromaloom.plans.ctes import build
from chromaloom.plans.fixtures import BANDS, CONTEXT, HEIGHT, RESOLUTION, WIDTH, fixture, table
from chromaloom.plans.registry import query
from chromaloom.session import materialise, scratch_path
from chromaloom.sources import fasta, readers, writers

CHUNK, HALO = 512, CONTEXT


def write_lines(df: DataFrame, order: str, columns: list[str], sep: str, label: str, header: str | None = None) -> str:
    """Text files whose names sort in row order."""
    lines = df.select(F.col(order).alias("_at"), F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value"))
    if header is not None:
        top = df.sparkSession.createDataFrame([(-1, header)], "_at bigint, value string")
        lines = lines.unionByName(top)
    path = scratch_path(df.sparkSession, label)
    lines.orderBy("_at").select("value").write.text(path)
    return path


BEDPE = ["chr1", "start1", "end1", "chr2", "start2", "end2", "name", "score", "strand1", "strand2"]


@query("a1_read_contacts", build("SELECT accession, chrom1, chrom2, pos1, pos2, counts FROM fx_contacts"))
def read_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixture(spark, sf_dir, "fx_contacts")
    tagged = raw.withColumn("norm", F.explode(F.array(F.lit("NONE"), F.lit("KR"))))
    path = scratch_path(spark, "contacts-tsv")
    tagged.select("accession", "norm", "chrom1", "chrom2", "pos1", "pos2", "counts").write.csv(path, sep="\t")
    return readers.read_contacts(spark, path, "tsv", "NONE")


@query("a2_read_bedpe10", build("SELECT * FROM fx_regions"))
def read_bedpe10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_lines(fixture(spark, sf_dir, "fx_regions"), "bedpe_idx", BEDPE, "\t", "bedpe")
    return readers.read_bedpe10(spark, path).withColumn("score", F.col("score").cast("bigint"))


@query("a3_read_bedpe6", build("SELECT bedpe_idx, chr1, start1, end1, chr2, start2, end2 FROM fx_regions"))
def read_bedpe6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = fixture(spark, sf_dir, "fx_regions").withColumn("chr1", F.regexp_replace("chr1", "^chr", ""))
    return readers.read_bedpe6(spark, write_lines(bare, "bedpe_idx", BEDPE[:6], "\t", "bedpe6"))


@query("a4_read_bed", build("SELECT * FROM fx_bed"))
def read_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bed = fixture(spark, sf_dir, "fx_bed").withColumns({"name": F.lit("x"), "score": F.lit(0)})
    columns = ["chrom", "start_bp", "end_bp", "name", "score", "strand"]
    return readers.read_bed(spark, write_lines(bed, "region_idx", columns, "\t", "bed"))


@query(
    "a5_read_fasta",
    build(
        f"""SELECT chrom, i AS chunk_idx, substr(seq, i * {CHUNK} + 1, {CHUNK + HALO}) AS seq
        FROM (SELECT chrom, seq, unnest(generate_series(0, (length(seq) - 1) // {CHUNK})) AS i FROM fx_contigs)"""
    ),
)
def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = fixture(spark, sf_dir, "fx_contigs")
    wrapped = F.regexp_replace("seq", "(?s)(.{60})(?=.)", "$1\n")
    text = contigs.select(F.concat(F.lit(">"), F.col("chrom"), F.lit(" derived\n"), wrapped).alias("value"))
    path = scratch_path(spark, "fasta")
    text.write.text(path)
    chunks, _ = fasta.read_fasta(spark, path, CHUNK, HALO)
    return chunks


@query("a6_read_expression", build("SELECT rna_accession, gene_id, tpm FROM fx_expr"))
def read_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "expression")
    expr = fixture(spark, sf_dir, "fx_expr")
    expr.select("rna_accession", F.lit(0.5).alias("FPKM"), "gene_id", F.col("tpm").alias("TPM")).write.partitionBy(
        "rna_accession"
    ).csv(path, sep="\t", header=True)
    return readers.read_expression(spark, path, by_folder=True)


@query("a6_read_expression_files", build("SELECT rna_accession, gene_id, tpm FROM fx_expr"))
def read_expression_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of ``*.tsv`` files, each named by its accession."""
    path = scratch_path(spark, "expression-files")
    expr = fixture(spark, sf_dir, "fx_expr").select("rna_accession", "gene_id", F.col("tpm").alias("TPM"))
    expr.repartition("rna_accession").write.partitionBy("rna_accession").csv(f"{path}/folders", sep="\t", header=True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(f"{path}/files"))
    for part in files.globStatus(hadoop.Path(f"{path}/folders/rna_accession=*/part-*.csv")):
        accession = part.getPath().getParent().getName().removeprefix("rna_accession=")
        files.rename(part.getPath(), hadoop.Path(f"{path}/files/{accession}.tsv"))
    return readers.read_expression(spark, f"{path}/files")


@query(
    "a7_read_accessions",
    """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS bio_idx, 'ENCFF' || CAST(s_suppkey AS VARCHAR) AS accession
    FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <> 3""",
)
def read_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" ENCFF"), F.col("s_suppkey").cast("string"), F.lit(" "))
    line = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("  #"), name)).when(F.col("s_nationkey") == 3, "  ").otherwise(name)
    suppliers = table(spark, sf_dir, "supplier").withColumn("line", line)
    return readers.read_accessions(spark, write_lines(suppliers, "s_suppkey", ["line"], "", "accessions"))


@query(
    "a8_read_pairs",
    """SELECT 'ENCRNA' || CAST(s_nationkey AS VARCHAR) AS rna_accession,
       max_by('ENCHIC' || CAST(s_suppkey AS VARCHAR), s_suppkey) AS hic_accession
    FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey""",
)
def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("ENCHIC"), F.col("s_suppkey").cast("string")).alias("hic"),
        F.when(F.col("s_acctbal") > 0, "human").otherwise("mouse").alias("organism"),
        F.concat(F.lit("ENCRNA"), F.col("s_nationkey").cast("string")).alias("rna"),
    )
    path = write_lines(rows, "s_suppkey", ["hic", "organism", "rna"], "\t", "pairs", "Hi-C Accession\tOrganism\tRNA Accession")
    return readers.read_pairs(spark, path)


@query("a9_read_genes", build("SELECT * FROM fx_genes"))
def read_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_lines(fixture(spark, sf_dir, "fx_genes"), "gene_idx", ["gene_id", "chrom"], ",", "genes", "gene_id,chrom")
    return readers.read_genes(spark, path)


TARGETS = ["submat_key", "r0", "r1", "c0", "c1", "seq_row", "gene_symbol", "enhancer_id", "regulated"]


@query("a10_read_targets", build("SELECT * FROM fx_targets"))
def read_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = fixture(spark, sf_dir, "fx_targets").withColumn("submat_key", F.concat(F.lit('"'), F.col("submat_key"), F.lit('"')))
    header = ",".join([*TARGETS[:-1], "Regulated"])
    path = write_lines(quoted, "target_idx", TARGETS, ",", "targets", header)
    return readers.read_targets(spark, path).withColumnRenamed("Regulated", "regulated")


@query("a11_read_k_median", build("SELECT k, value FROM fx_k_median"))
def read_k_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "k-median")
    fixture(spark, sf_dir, "fx_k_median").write.parquet(path)
    return readers.read_k_median(spark, path, BANDS)


@query(
    "a12_read_embeddings",
    build("SELECT m, b, CAST(len(vec) AS BIGINT) AS size, round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 6) + 0.0::DOUBLE AS total FROM fx_emb"),
)
def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "embeddings")
    fixture(spark, sf_dir, "fx_emb").write.parquet(path)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return readers.read_embeddings(spark, path, 8).select(
        "m", "b", F.size("vec").cast("bigint").alias("size"), F.round(total, 6).alias("total")
    )


@query("a13_read_weights", build("SELECT m, w FROM fx_weights"))
def read_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "weights")
    fixture(spark, sf_dir, "fx_weights").write.parquet(path)
    return readers.read_weights(spark, path, fixture(spark, sf_dir, "fx_emb"))


@query(
    "a14_fetch_manifest",
    """SELECT accession, accession LIKE '%EN%' AS is_known,
       CASE WHEN accession LIKE '%EN%' THEN 'https://www.encodeproject.org/files/' || accession || '/@@download/' || accession || '.hic' END AS url
    FROM (SELECT CASE WHEN s_acctbal < 5000 THEN 'ENCFF' ELSE 'GSM' END || CAST(s_suppkey AS VARCHAR) AS accession FROM supplier)""",
)
def fetch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_acctbal") < 5000, "ENCFF").otherwise("GSM")
    named = table(spark, sf_dir, "supplier").select(F.concat(kind, F.col("s_suppkey").cast("string")).alias("accession"))
    return readers.fetch_manifest(named, "hic")


def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.symmetrise(ft.window_job(spark, sf_dir).kept)


def coverage_sql(power: str) -> str:
    return build(
        """SELECT accession, chrom, row, col,
           round(x * sum(value) OVER (PARTITION BY accession, chrom) / sum(x) OVER (PARTITION BY accession, chrom), 6) + 0.0::DOUBLE AS value FROM scaled""",
        scaled=f"""(SELECT s.*, s.value / pow(a.m * b.m, {power}::DOUBLE) AS x FROM sym s
                JOIN (SELECT accession, chrom, row, sum(value) AS m FROM sym GROUP BY ALL) a ON (s.accession, s.chrom, s.row) = (a.accession, a.chrom, a.row)
                JOIN (SELECT accession, chrom, row, sum(value) AS m FROM sym GROUP BY ALL) b ON (s.accession, s.chrom, s.col) = (b.accession, b.chrom, b.row))""",
    )


def coverage(spark: SparkSession, sf_dir: str, norm: str) -> DataFrame:
    found = balance.normalise(symmetric(spark, sf_dir), norm)
    whole = {c: F.col(c).cast("bigint") for c in ("row", "col")}
    return found.withColumns({**whole, "value": F.round("value", 6)})


@query("a1_coverage", coverage_sql("1.0"))
def coverage_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir, "VC")


@query("a1_root_coverage", coverage_sql("0.5"))
def root_coverage_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir, "VC_SQRT")


@query(
    "a1_balanced_margins",
    build("SELECT accession, chrom, row AS bin, 1.0::DOUBLE AS margin, 1.0::DOUBLE AS kept FROM sym GROUP BY accession, chrom, row"),
)
def balanced_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of the balanced matrices over their mean, and the share of each total that is kept.

    The derived contacts lack a strong diagonal, without which no balance need exist, so each bin's margin is added to it.
    """
    raw = materialise(symmetric(spark, sf_dir), "symmetric")
    diagonal = balance.margins(raw).select("accession", "chrom", F.col("bin").alias("row"), F.col("bin").alias("col"), F.col("margin").alias("value"))
    cells = materialise(contacts.sum_cells(raw.unionByName(diagonal)), "with-diagonal")
    totals = cells.groupBy("accession", "chrom").agg(F.sum(F.col("value").cast("double")).alias("total"))
    margins = materialise(balance.margins(balance.normalise(cells, "KR")), "balanced")
    after = margins.groupBy("accession", "chrom").agg(F.avg("margin").alias("mean"), F.sum("margin").alias("balanced"))
    return margins.join(after.join(totals, ["accession", "chrom"]), ["accession", "chrom"]).select(
        "accession",
        "chrom",
        F.col("bin").cast("bigint").alias("bin"),
        F.round(F.col("margin") / F.col("mean"), 2).alias("margin"),
        F.round(F.col("balanced") / F.col("total"), 6).alias("kept"),
    )


# Block side of the stored contacts, scaled like the windows.
STORED = 64
BLOCK_SQL = f"""chrom || '.' || CAST(least(row, col) // {STORED} AS VARCHAR) || '.'
    || CAST(length(bin(greatest(row, col) // {STORED} - least(row, col) // {STORED} + 1)) - 1 AS VARCHAR)"""


def contact_store(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "tiled-contacts")
    pipelines.store_contacts(fixture(spark, sf_dir, "fx_contacts"), path, RESOLUTION, STORED)
    return path


def stored_job(spark: SparkSession, sf_dir: str) -> pipelines.StoredWindowJob:
    return pipelines.stored_windows(spark, contact_store(spark, sf_dir), fixture(spark, sf_dir, "fx_regions"), RESOLUTION, HEIGHT, WIDTH)


@query("k1_tiled_contacts", build(f"SELECT accession, chrom AS chrom1, row, col, value, {BLOCK_SQL} AS block FROM cis"))
def tiled_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = readers.read_tiled_contacts(spark, contact_store(spark, sf_dir))
    whole = {c: F.col(c).cast("bigint") for c in ("row", "col")}
    return stored.withColumns({**whole, "value": F.col("value").cast("double")})


@query("j1_stored_windows", build("SELECT accession, submat_key, nnz, CAST(total AS DOUBLE) AS total, is_empty FROM win_stats"))
def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a contact store, from the blocks they touch."""
    return pipelines.window_summary(stored_job(spark, sf_dir))


@query(
    "j1_blocks_read",
    build(
        f"""SELECT accession, {BLOCK_SQL} AS block, count(*) AS contacts FROM cis WHERE {BLOCK_SQL} IN (
             SELECT chrom || '.' || CAST(least(i, k) AS VARCHAR) || '.' || CAST(length(bin(abs(i - k) + 1)) - 1 AS VARCHAR)
             FROM wins, generate_series(0, 400) AS g(i), generate_series(0, 400) AS h(k)
             WHERE i BETWEEN rs // {STORED} AND (rs + {HEIGHT - 1}) // {STORED} AND k BETWEEN cs // {STORED} AND (cs + {WIDTH - 1}) // {STORED})
           GROUP BY ALL"""
    ),
)
def blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by block that a window job reads from the store; its scan prunes the other partitions."""
    return stored_job(spark, sf_dir).touched.groupBy("accession", "block").agg(F.count(F.lit(1)).alias("contacts"))


@query("k1_write_contacts", build("SELECT accession, chrom AS chrom1, row, col, value FROM cis"))
def write_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "contact-store")
    writers.write_contacts(ft.cis(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.select(
        F.col("accession").cast("string").alias("accession"),
        F.col("chrom1").cast("string").alias("chrom1"),
        F.col("row").cast("bigint").alias("row"),
        F.col("col").cast("bigint").alias("col"),
        F.col("value").cast("double").alias("value"),
    )


@query(
    "k2_write_windows",
    build(
        """SELECT accession, submat_key, nnz AS n, CAST(total AS DOUBLE) AS total, is_empty, CAST(total_count AS DOUBLE) AS total_count
        FROM win_stats"""
    ),
)
def write_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "window-store")
    writers.write_windows(ft.records(spark, sf_dir), path)
    total = F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x)
    return spark.read.parquet(path).select(
        "accession", "submat_key", F.size("data").cast("bigint").alias("n"), total.alias("total"), "is_empty", "total_count"
    )


@query(
    "k3_write_invalid_bed",
    build(
        """SELECT v.accession, v.chrom, v.rs, v.cs FROM valid v
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.accession = v.accession AND s.submat_key = v.submat_key)"""
    ),
)
def write_invalid_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "invalid-bed")
    schema = "chrom string, rs bigint, cs bigint, accession string"
    if not writers.write_invalid_bed(ft.empty(spark, sf_dir), path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, sep="\t")


LABEL_SQL = build(
    "SELECT seq_split, bio_split, bio_idx, gene_idx, round(CAST(y AS DOUBLE), 4) + 0.0::DOUBLE AS y, is_missing FROM labels_split"
)


@query("k4_write_labels", LABEL_SQL)
def write_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "label-store")
    writers.write_labels(ft.labels_split(spark, sf_dir), path)
    return ft.label_view(spark.read.parquet(path))


@query("k5_write_tokens", build("SELECT region_idx, token_text FROM tokens", bed_source="fx_bed"))
def write_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    writers.write_tokens(ft.bed_tokens(spark, sf_dir).select("region_idx", "token_text"), path)
    return spark.read.parquet(path)


@query(
    "k6_write_embeddings",
    build(
        f"""SELECT b, m, CAST(i AS BIGINT) AS i, {ft.half_sql('x')} AS v
        FROM (SELECT b, m, i, CAST(vec[i + 1] AS DOUBLE) AS x FROM fx_emb, generate_series(0, 63) AS g(i))"""
    ),
)
def write_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "embedding-store")
    writers.write_embeddings(fixture(spark, sf_dir, "fx_emb"), path, ("b", "m"))
    rows = spark.read.parquet(path).select("b", "m", F.posexplode("vec").alias("i", "v"))
    return rows.select("b", "m", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"))


@query("k7_write_predictions", build("SELECT bio_idx, bedpe_idx, CAST(nnz AS DOUBLE) / 8 AS y FROM assembled"))
def write_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "prediction-store")
    counts = ft.assembled(spark, sf_dir).select("bio_idx", "bedpe_idx", (F.size("data") / 8.0).alias("y"))
    writers.write_predictions(counts, path)
    return spark.read.parquet(path)


@query(
    "k8_write_perturbation_csv",
    build(
        """SELECT submat_key, r0, r1, c0, c1, seq_row, gene_symbol, enhancer_id, regulated, CAST(c0 AS DOUBLE) / 8 AS y_orig,
           CAST(c1 AS DOUBLE) / 4 AS y_pert, CAST(c1 AS DOUBLE) / 4 - CAST(c0 AS DOUBLE) / 8 AS delta FROM fx_targets"""
    ),
)
def write_perturbation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = fixture(spark, sf_dir, "fx_targets")
    preds = targets.select("target_idx", (F.col("c0") / 8.0).alias("y_orig"), (F.col("c1") / 4.0).alias("y_pert"))
    scored = perturb.attach_predictions(targets, preds.withColumn("delta", F.col("y_pert") - F.col("y_orig")))
    path = scratch_path(spark, "perturbation-csv")
    writers.write_perturbation_csv(scored, path)
    kinds = dict(targets.drop("target_idx").dtypes)
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", y_orig double, y_pert double, delta double"
    return spark.read.schema(schema).csv(path, header=True)


@query("k9_write_attributions", ft.ATTRIBUTION_SQL)
def write_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "attribution-store")
    writers.write_attributions(ft.attributions(spark, sf_dir, "float64"), path)
    stored = spark.read.parquet(path).withColumn("accession", F.col("accession").cast("string"))
    return ft.attribution_view(infer.array_totals(stored, seq_total="seq_attr", hic_total="hic_attr"))


@query(
    "k10_pending",
    """SELECT 'ENCFF' || CAST(s_suppkey AS VARCHAR) AS accession FROM supplier
    WHERE s_acctbal >= 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.concat(F.lit("ENCFF"), F.col(key).cast("string")).alias("accession"))

    suppliers = table(spark, sf_dir, "supplier")
    available = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return writers.pending(
        named(suppliers, "s_suppkey"), named(suppliers.where("s_acctbal < 0"), "s_suppkey"), named(available, "l_suppkey")
    )


@query(
    "k10_resume_windows",
    build(
        """SELECT r.run, k.accession, count(*) AS windows FROM keys k, (VALUES (1), (3)) AS r(run)
        WHERE r.run = 1 OR k.accession = (SELECT min(accession) FROM keys) GROUP BY r.run, k.accession"""
    ),
)
def resume_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs into one store: the second finds nothing to do, before the third the first store is taken away."""
    path = scratch_path(spark, "window-store")
    raw, bedpe = fixture(spark, sf_dir, "fx_contacts"), fixture(spark, sf_dir, "fx_regions")
    listed = fixture(spark, sf_dir, "fx_biosamples").select("accession")
    runs = []
    for run in (1, 2, 3):
        if run == 3:
            writers.drop_partition(spark, path, "accession", min(writers.partition_values(spark, path, "accession")))
        made = pipelines.resume_windows(raw, bedpe, listed, path, RESOLUTION, HEIGHT, WIDTH)
        runs.append(made.select(F.lit(run).alias("run"), "accession", "windows"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query(
    "k10_missing_inputs",
    """SELECT 'ENCFF' || CAST(s_suppkey AS VARCHAR) AS accession FROM supplier
    WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 4 <> 1)""",
)
def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessions whose input was never delivered."""
    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.concat(F.lit("ENCFF"), F.col(key).cast("string")).alias("accession"))

    delivered = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 <> 1")
    return writers.missing_inputs(named(table(spark, sf_dir, "supplier"), "s_suppkey"), named(delivered, "l_suppkey"))


@query(
    "k7_write_sequence_predictions",
    build(
        f"""SELECT region_idx, CAST(b AS BIGINT) AS bio_idx, round({ft.SEQ_SQL} + b * (f0 + f1 + f2 + f3), 6) + 0.0::DOUBLE AS y_hat
        FROM freq, generate_series(0, 2) AS g(b)""",
        bed_source="fx_bed",
    ),
)
def write_sequence_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence-only predictions in the order of a (biosamples, items) matrix."""
    tokens, items = ft.bed_tokens(spark, sf_dir), fixture(spark, sf_dir, "fx_bed").count()
    preds = infer.predict(tokens, ft.sequence_model, ("region_idx",), "sequence", batch_size=64, dtype="float64", partitions=ft.tasks(spark, items))
    path = scratch_path(spark, "sequence-predictions")
    writers.write_predictions(infer.per_biosample(preds), path, ("bio_idx", "region_idx"))
    stored = spark.read.parquet(path)
    return stored.select("region_idx", F.col("bio_idx").cast("bigint").alias("bio_idx"), F.round("y_hat", 6).alias("y_hat"))
