import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.operators import contacts
from chromaloom.sources import fasta, lines, readers, writers


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_lines_keep_file_order_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "x.txt", "".join(f"row {i}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        got = lines.ordered_lines(spark, path)
        assert got.select("_block").distinct().count() > 5
        assert [(r.line_idx, r.value) for r in got.orderBy("line_idx").collect()] == [(i, f"row {i}") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_accession_list_skips_blanks_and_comments(spark, tmp_path):
    path = write(tmp_path / "list.csv", " A \r\n\n  # no\nB\n#C\nD")
    got = readers.read_accessions(spark, path).orderBy("bio_idx").collect()
    assert [(r.bio_idx, r.accession) for r in got] == [(0, "A"), (1, "B"), (2, "D")]


def test_bedpe_needs_one_chromosome_per_row(spark, tmp_path):
    good = write(tmp_path / "g.bedpe", "1\t0\t5\tchr1\t2\t9\tg\t0\t-\t.\textra\n\nchr2\t1\t2\t2\t3\t4\th\t0\t+\t.\n")
    rows = readers.read_bedpe10(spark, good).orderBy("bedpe_idx").collect()
    assert [(r.bedpe_idx, r.chr1, r.chr2, r.start2, r.strand1) for r in rows] == [(0, "chr1", "chr1", 2, "-"), (1, "chr2", "chr2", 3, "+")]
    bad = write(tmp_path / "b.bedpe", "1\t0\t5\t2\t2\t9\tg\t0\t-\t.\n")
    with pytest.raises(ValueError, match="chr1 equal to chr2"):
        readers.read_bedpe10(spark, bad)
    assert readers.read_bedpe6(spark, bad).first().chr2 == "chr2"


@pytest.mark.parametrize(
    "text, strands",
    [("chr1\t0\t5\nchr2\t1\t6\n", ["+", "+"]), ("chr1\t0\t5\tn\t0\t-\nchr2\t1\t6\tm\t0\t+\tmore\n", ["-", "+"])],
)
def test_first_bed_line_decides_about_strands(spark, tmp_path, text, strands):
    rows = readers.read_bed(spark, write(tmp_path / "x.bed", text)).orderBy("region_idx").collect()
    assert [r.strand for r in rows] == strands
    assert [(r.chrom, r.start_bp, r.end_bp) for r in rows] == [("chr1", 0, 5), ("chr2", 1, 6)]


def test_expression_files_are_named_by_accession(spark, tmp_path):
    write(tmp_path / "R1.tsv", "gene_id\tlength\tTPM\nG1\t9\t1.5\nG2\t9\t0\n")
    write(tmp_path / "R2.tsv", "gene_id\tlength\tTPM\nG1\t9\t2\n")
    write(tmp_path / "notes.txt", "gene_id\tlength\tTPM\nG9\t9\t2\n")
    got = {tuple(r) for r in readers.read_expression(spark, str(tmp_path)).collect()}
    assert got == {("R1", "G1", 1.5), ("R1", "G2", 0.0), ("R2", "G1", 2.0)}


def test_last_pair_of_a_name_wins_among_humans(spark, tmp_path):
    text = "Hi-C Accession\tOrganism\tRNA Accession\nH1\thuman\tR1\nH2\thuman\tR1\nH3\tmouse\tR1\nH4\tmouse\tR2\n"
    got = readers.read_pairs(spark, write(tmp_path / "p.tsv", text)).collect()
    assert [tuple(r) for r in got] == [("R1", "H2")]


def test_genes_and_targets_keep_file_order(spark, tmp_path):
    genes = write(tmp_path / "g.csv", 'gene_id,name,chrom\nB,"x, y",chr4\nA,z,chr1\n')
    rows = readers.read_genes(spark, genes).orderBy("gene_idx").collect()
    assert [(r.gene_idx, r.gene_id, r.name, r.chrom) for r in rows] == [(0, "B", "x, y", "chr4"), (1, "A", "z", "chr1")]
    targets = write(tmp_path / "t.csv", 'submat_key,r0,r1,c0,c1,seq_row\n"chr1:0,0",0,192,5,9,3\n')
    row = readers.read_targets(spark, targets).first()
    assert (row.target_idx, row.submat_key, row.r1, row.seq_row) == (0, "chr1:0,0", 192, 3)


def test_expectation_must_be_complete(spark):
    good = spark.createDataFrame([(i, 1.0) for i in range(4)], "k bigint, value double")
    assert readers.check_k_median(good, 4) is good
    with pytest.raises(ValueError):
        readers.check_k_median(good, 5)
    with pytest.raises(ValueError):
        readers.check_k_median(good.withColumn("k", F.least("k", F.lit(2))), 4)


def test_embedding_and_weight_shapes(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "m bigint, vec array<float>")
    assert readers.check_vectors(table, 2) is table
    with pytest.raises(ValueError):
        readers.check_vectors(table, 3)
    with pytest.raises(ValueError):
        readers.check_vectors(table.union(spark.createDataFrame([(2, [1.0])], "m bigint, vec array<float>")), 1)
    assert {r.w for r in readers.read_weights(spark, None, table).collect()} == {1.0}
    with pytest.raises(ValueError):
        readers.check_weights(spark.createDataFrame([(0, 2.0)], "m bigint, w double"), table)


def test_manifest(spark):
    rows = readers.fetch_manifest(spark.createDataFrame([("ENCFF1",), ("GSM1",)], "accession string"), "tsv").collect()
    assert [(r.is_known, r.url) for r in rows] == [(True, "https://www.encodeproject.org/files/ENCFF1/@@download/ENCFF1.tsv"), (False, None)]


def test_contacts_of_one_normalisation(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "a\tNONE\t1\t1\t5\t7\t2.5\na\tKR\t1\t1\t5\t7\t0.5\n")
    assert [r.counts for r in readers.read_contacts(spark, path, norm="KR").collect()] == [0.5]
    with pytest.raises(ValueError):
        readers.read_contacts(spark, path, norm="X")


@pytest.mark.parametrize("split", ["128mb", "200b"])
def test_fasta_chunks_over_contigs_and_blocks(spark, tmp_path, split):
    rng = np.random.default_rng(5)
    contigs = {f"c{i}": "".join(rng.choice(list("ACGTacgtN"), n)) for i, n in enumerate([1, 300, 75, 1200, 7])}
    body = ""
    for i, (name, seq) in enumerate(contigs.items()):
        width = 60 if i % 2 else 5000
        body += f">{name} some words\r\n" + "".join(seq[a : a + width] + "\r\n" for a in range(0, len(seq), width)) + "\n"
    path = write(tmp_path / "x.fa", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        chunks, lengths = fasta.read_fasta(spark, path, chunk=100, halo=30)
        assert {r.chrom: r.contig_len for r in lengths.collect()} == {k: len(v) for k, v in contigs.items()}
        got = {(r.chrom, r.chunk_idx): r.seq for r in chunks.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(k, i): v[i * 100 : i * 100 + 130] for k, v in contigs.items() for i in range((len(v) + 99) // 100)}


def test_long_lines_are_chunked_without_loss(spark):
    seq = "ACGTTGCA" * 2000
    contigs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    chunks = fasta.chunk_lines(fasta.contig_lines(contigs), 5000, 1000)
    assert {r.chunk_idx: r.seq for r in chunks.collect()} == {i: seq[i * 5000 : i * 5000 + 6000] for i in range(4)}


def test_repeated_writes_replace_only_their_partition(spark, tmp_path):
    schema = "accession string, chrom1 string, row int, col int, value float"
    path = str(tmp_path / "store")
    writers.write_contacts(spark.createDataFrame([("a", "chr1", 0, 0, 1.0), ("b", "chr1", 0, 0, 2.0)], schema), path)
    writers.write_contacts(spark.createDataFrame([("a", "chr1", 0, 0, 5.0)], schema), path)
    assert {(r.accession, r.value) for r in spark.read.parquet(path).collect()} == {("a", 5.0), ("b", 2.0)}
    plan = spark.read.parquet(path).where("accession = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(accession" in plan


def test_pending_and_missing(spark):
    def table(*names):
        return spark.createDataFrame([(n,) for n in names], "accession string")

    todo = writers.pending(table("a", "b", "c"), table("a"), table("a", "b"))
    assert [r.accession for r in todo.collect()] == ["b"]
    assert [r.accession for r in writers.missing_inputs(table("a", "c"), table("a")).collect()] == ["c"]


def test_invalid_bed_is_written_only_when_needed(spark, tmp_path):
    schema = "accession string, bedpe_idx bigint, chrom string, rs bigint, cs bigint"
    path = tmp_path / "invalid"
    assert not writers.write_invalid_bed(spark.createDataFrame([], schema), str(path))
    assert not path.exists()
    rows = [("a", 1, "chr1", 5, 7), ("a", 0, "chr1", 5, 7)]
    assert writers.write_invalid_bed(spark.createDataFrame(rows, schema), str(path))
    assert sorted(r.value for r in spark.read.text(str(path)).collect()) == ["chr1\t5\t7"] * 2


def test_stale_list_of_empty_windows_goes(spark, tmp_path):
    schema = "accession string, bedpe_idx bigint, chrom string, rs bigint, cs bigint"
    path = str(tmp_path / "invalid")
    writers.write_invalid_bed(spark.createDataFrame([(a, 0, "chr1", 5, 7) for a in ("a", "b", "c d")], schema), path)
    processed = spark.createDataFrame([("a",), ("c d",), ("new",)], "accession string")
    now = spark.createDataFrame([("a", 1, "chr1", 1, 2)], schema)
    assert writers.write_invalid_bed(now, path, processed) == 1
    assert writers.partition_values(spark, path, "accession") == {"a", "b"}
    assert writers.write_invalid_bed(now.limit(0), path, processed) == 0
    assert writers.partition_values(spark, path, "accession") == {"b"}


def test_labels_tokens_embeddings_predictions_round_trip(spark, tmp_path):
    emb = spark.createDataFrame([(1, 0, [0.1, 70000.0]), (0, 1, [1.0, 2.0])], "b bigint, m bigint, vec array<float>")
    writers.write_embeddings(emb, str(tmp_path / "e"), ("b", "m"))
    got = {(r.b, r.m): r.vec for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert got == {(1, 0): [float(np.float16(0.1)), float("inf")], (0, 1): [1.0, 2.0]}
    labels = spark.createDataFrame([("train", "val", 0, 3, 1.5)], "seq_split string, bio_split string, bio_idx bigint, gene_idx bigint, y float")
    writers.write_labels(labels, str(tmp_path / "l"))
    assert (tmp_path / "l" / "seq_split=train" / "bio_split=val").is_dir()
    preds = spark.createDataFrame([(1, 0, 3.0), (0, 1, 2.0), (0, 0, 1.0)], "bio_idx bigint, bedpe_idx bigint, y double")
    writers.write_predictions(preds, str(tmp_path / "p"))
    files = sorted((tmp_path / "p").glob("part-*"))
    flat = [r.y for f in files for r in spark.read.parquet(str(f)).collect()]
    assert flat == [1.0, 2.0, 3.0]


def test_perturbation_csv_has_header_and_no_index(spark, tmp_path):
    scored = spark.createDataFrame([(0, "chr1:0,0", 1.0, 3.0, 2.0)], "target_idx bigint, submat_key string, y_orig double, y_pert double, delta double")
    writers.write_perturbation_csv(scored, str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_text().splitlines()
    assert text == ["submat_key,y_orig,y_pert,delta", '"chr1:0,0",1.0,3.0,2.0']


def test_normalisation_tags():
    assert "NONE" in contacts.NORMALISATIONS


def test_running_totals_of_a_fasta_take_bounded_blocks(spark, tmp_path):
    """However large a split is: its lines go to the window in blocks of a few, with the same offsets."""
    text = "".join(f">c{i} x\n" + "ACGT\n" * (3 * i) + "A\n" for i in range(9))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">d\nAC\nG\n")
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = [(f"c{i}", 4 * j, "ACGT" if j < 3 * i else "A") for i in range(9) for j in range(3 * i + 1)] + [("d", 0, "AC"), ("d", 2, "G")]
    for most in (1, 7, 1000):
        assert plain(fasta.read_fasta_lines(spark, str(tmp_path), most)) == sorted(want)
