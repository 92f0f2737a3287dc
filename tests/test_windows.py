import numpy as np
import pytest

from chromaloom.operators import contacts, image, regions, windows
from chromaloom.plans import pipelines
from chromaloom.session import materialise
from chromaloom.sources import readers, writers

RAW = "accession string, chrom1 string, chrom2 string, pos1 bigint, pos2 bigint, counts double"
BED = (
    "bedpe_idx bigint, chr1 string, start1 bigint, end1 bigint, chr2 string, start2 bigint, end2 bigint, "
    "name string, score bigint, strand1 string, strand2 string"
)


def region(i, chrom, start1, start2, strand):
    return (i, chrom, start1, start1 + 4, chrom, start2, start2 + 8, "g", 0, strand, ".")


def random_contacts(rng, accession, chrom, size, n):
    a, b = rng.integers(0, size, n), rng.integers(0, size, n)
    low, high = np.minimum(a, b), np.maximum(a, b)
    return [(accession, chrom, chrom, int(x), int(y), float(v)) for x, y, v in zip(low, high, rng.integers(1, 9, n))]


def dense(rows, accession, chrom, size):
    matrix = np.zeros((size, size))
    for acc, c, _, x, y, v in rows:
        if acc == accession and c == chrom:
            matrix[x, y] += v
            if x != y:
                matrix[y, x] += v
    return matrix


def test_windows_equal_dense_slices(spark):
    """Symmetrised windows, with flips, matrix edges, repeated cells and two accessions."""
    rng = np.random.default_rng(7)
    rows = random_contacts(rng, "a", "chr1", 40, 500) + random_contacts(rng, "b", "chr1", 40, 300) + random_contacts(rng, "a", "chr2", 30, 200)
    rows += [("a", "chr1", "chr1", 39, 39, 5.0), ("b", "chr1", "chr1", 39, 39, 5.0), ("a", "chr2", "chr2", 29, 29, 1.0)]
    bed = [region(i, f"chr{i % 2 + 1}", int(rng.integers(0, 40)), int(rng.integers(0, 40)), "+-"[int(rng.integers(2))]) for i in range(60)]
    height, width = 6, 14
    job = pipelines.contact_windows(spark.createDataFrame(rows, RAW), spark.createDataFrame(bed, BED), 1, height, width)
    records = {(r.accession, r.submat_key): r for r in pipelines.window_records(job).collect()}
    last = {f"{b[1]}:{b[2]},{b[5]}": b for b in bed}
    expected = 0
    for accession, chrom, size in (("a", "chr1", 40), ("b", "chr1", 40), ("a", "chr2", 30)):
        matrix = dense(rows, accession, chrom, size)
        for key, b in last.items():
            if b[1] != chrom or b[2] >= size or b[5] >= size:
                continue
            expected += 1
            cut = matrix[b[2] : b[2] + height, b[5] : b[5] + width]
            full = np.zeros((height, width))
            full[: cut.shape[0], : cut.shape[1]] = cut
            if b[9] == "-":
                full = full[::-1, ::-1]
            got = np.zeros((height, width))
            record = records[accession, key]
            got[record.row, record.col] = record.data
            assert np.array_equal(got, full), key
            assert record.is_empty == (not cut.any())
    assert len(records) == expected


def test_broadcast_and_shuffled_tiles_agree(spark):
    """Contacts outside all windows are dropped before the sum in either plan."""
    rng = np.random.default_rng(3)
    raw = spark.createDataFrame(random_contacts(rng, "a", "chr1", 60, 600) + random_contacts(rng, "b", "chr1", 50, 300), RAW)
    bed = spark.createDataFrame([region(i, "chr1", i, 2 * i, "+") for i in range(25)], BED)
    job = pipelines.contact_windows(raw, bed, 1, 6, 14)
    once = sorted(map(tuple, job.cells.drop("flip").collect()))
    wanted = windows.distinct_windows(job.binned)
    shuffled = windows.extract_from_contacts(job.kept, wanted, 6, 14, job.dims, broadcast_rows=0)
    plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    assert sorted(map(tuple, windows.strand_flip(shuffled, 6, 14).collect())) == once


def test_last_region_decides_the_flip(spark):
    bed = [region(0, "chr1", 2, 2, "+"), region(1, "chr1", 2, 2, "-"), region(2, "chr1", 3, 3, "-"), region(3, "chr1", 3, 3, "+")]
    got = windows.distinct_windows(regions.window_regions(spark.createDataFrame(bed, BED), 1)).collect()
    assert {r.submat_key: r.flip for r in got} == {"chr1:2,2": True, "chr1:3,3": False}


def test_small_chromosomes_do_not_count(spark):
    rows = [("a", "1", "1", 0, 9, 3.0), ("a", "1", "1", 1, 1, 4.0), ("a", "2", "2", 0, 2, 100.0), ("b", "2", "2", 0, 1, 7.0)]
    job = pipelines.contact_windows(spark.createDataFrame(rows, RAW), spark.createDataFrame([region(0, "chr1", 0, 0, "+")], BED), 1, 4, 8)
    assert {r.accession: r.total_count for r in job.totals.collect()} == {"a": 7.0, "b": 0.0}
    assert {(r.accession, r.chrom) for r in job.dims.collect()} == {("a", "chr1")}


def test_zero_pairs_are_dropped_and_nan_sums_kept(spark):
    rows = [("a", "1", "1", 0, 1, 2.0), ("a", "1", "1", 0, 2, -2.0), ("a", "2", "2", 0, 0, float("nan")), ("a", "3", "3", 0, 0, 1.0)]
    binned = contacts.bin_contacts(spark.createDataFrame(rows, RAW), 1)
    stats = materialise(contacts.pair_stats(binned), "stats")
    assert {r.chrom1 for r in contacts.drop_zero_pairs(binned, stats).collect()} == {"2", "3"}


def test_trans_pairs_have_separate_sides(spark):
    rows = [("a", "1", "2", 4, 9, 1.0), ("a", "1", "1", 3, 7, 1.0)]
    dims = contacts.matrix_dims(contacts.bin_contacts(spark.createDataFrame(rows, RAW), 1)).collect()
    assert {(r.chrom1, r.chrom2, r.n_rows, r.n_cols) for r in dims} == {("1", "2", 5, 10), ("1", "1", 8, 8)}


def test_contact_modes(spark):
    rows = [("a", "2", "1", 0, 0, 1.0), ("a", "1", "2", 0, 0, 1.0), ("a", "1", "1", 0, 0, 1.0)]
    raw = spark.createDataFrame(rows, RAW)
    assert sorted(r.store_key for r in contacts.contact_mode(raw, 0, ["1", "2"]).collect()) == ["1_1", "1_2"]
    assert [r.store_key for r in contacts.contact_mode(raw, 3).collect()] == ["1"]
    with pytest.raises(ValueError):
        contacts.contact_mode(raw, 4)


def test_two_spellings_of_one_chromosome_are_refused(spark):
    rows = [("a", "1", "1", 0, 0, 1.0), ("a", "chr1", "chr1", 0, 0, 1.0)]
    with pytest.raises(ValueError, match="two ways"):
        pipelines.contact_windows(spark.createDataFrame(rows, RAW), spark.createDataFrame([region(0, "chr1", 0, 0, "+")], BED), 1, 4, 8)


def test_stored_zero_is_an_entry_but_gives_a_black_image(spark):
    rows = [("a", "1", "1", 0, 1, 0.0), ("a", "1", "1", 9, 9, 2.0)]
    bed = [region(0, "chr1", 0, 0, "+"), region(1, "chr1", 5, 0, "+")]
    job = pipelines.contact_windows(spark.createDataFrame(rows, RAW), spark.createDataFrame(bed, BED), 1, 4, 8)
    stats = {r.submat_key: (r.nnz, r.is_empty) for r in pipelines.window_summary(job).collect()}
    assert stats == {"chr1:0,0": (2, False), "chr1:5,0": (0, True)}
    pixels = windows.with_key(image.imagenet_normalize(image.contact_rgb(job.cells))).collect()
    assert {round(p.red, 6) for p in pixels} == {round(-0.485 / 0.229, 6)}
    assert [(e.chrom, e.rs, e.cs) for e in windows.empty_windows(job.valid, job.cells).collect()] == [("chr1", 5, 0)]


def test_negative_and_unknown_regions_are_skipped(spark):
    rows = [("a", "1", "1", 0, 9, 3.0)]
    bed = [region(0, "chr1", -3, 0, "+"), region(1, "chr9", 0, 0, "+"), region(2, "chr1", 99, 0, "+"), region(3, "chr1", 9, 9, "+")]
    job = pipelines.contact_windows(spark.createDataFrame(rows, RAW), spark.createDataFrame(bed, BED), 1, 4, 8)
    assert [r.bedpe_idx for r in job.valid.collect()] == [3]
    assert {(r.bedpe_idx, r.reason) for r in regions.skipped_regions(job.binned, job.dims).collect()} == {(0, "start"), (1, "chrom"), (2, "start")}


def test_clamped_ends_and_middle(spark):
    rows = [("a", "1", "1", 0, 9, 3.0)]
    job = pipelines.contact_windows(spark.createDataFrame(rows, RAW), spark.createDataFrame([region(0, "chr1", 8, 5, None)], BED), 1, 4, 8)
    row = regions.clamp_regions(job.valid).first()
    assert (row.re_clamped, row.ce_clamped, row.mid, row.flip) == (10, 10, 7, False)


def test_assemble_fills_missing_windows_and_keeps_a_stored_flag(spark):
    records = spark.createDataFrame(
        [("a", "chr1:0,0", [1], [1], [2.0], True, 9.0), ("a", "chr1:5,0", [], [], [], None, 9.0)],
        "accession string, submat_key string, row array<smallint>, col array<smallint>, data array<float>, is_empty boolean, total_count double",
    )
    bed = spark.createDataFrame([region(0, "chr1", 0, 0, "+"), region(1, "chr1", 5, 0, "+"), region(2, "chr1", 6, 0, "+"), region(3, "chr1", 0, 0, "+")], BED)
    bios = spark.createDataFrame([(0, "a"), (1, "ghost")], "bio_idx bigint, accession string")
    got = {
        (r.bio_idx, r.bedpe_idx): (len(r.data), r.is_empty, r.total_count)
        for r in windows.assemble(bios, regions.window_regions(bed, 1), records).collect()
    }
    assert got == {
        (0, 0): (1, True, 9.0), (0, 1): (0, True, 9.0), (0, 2): (0, True, 9.0), (0, 3): (1, True, 9.0),
        **{(1, i): (0, True, 0.0) for i in range(4)},
    }


def test_half_precision_counts_overflow_on_request(spark):
    cells = spark.createDataFrame([("a", "chr1", 0, 0, 0, 0, 70000.0), ("a", "chr1", 0, 0, 0, 1, 2049.0)], "accession string, chrom string, rs int, cs int, row int, col int, value float")
    assert windows.pack_windows(cells, ordered=True).first().data == [float("inf"), 2048.0]
    assert windows.pack_windows(cells, half=False, ordered=True).first().data == [70000.0, 2049.0]


def test_densify_adds_up_repeats_and_ignores_cells_outside(spark):
    records = spark.createDataFrame(
        [("a", "k", [0, 0, 1, 5], [0, 0, 2, 0], [1.0, 2.0, float("inf"), 9.0]), ("a", "e", [], [], [])],
        "accession string, submat_key string, row array<smallint>, col array<smallint>, data array<float>",
    )
    got = {r.submat_key: r.dense for r in image.densify(records, 2, 3).collect()}
    assert got["k"][:5] == [3.0, 0, 0, 0, 0] and got["k"][5] > 3e38
    assert got["e"] == [0.0] * 6
    assert windows.unpack_windows(records, 2, 3).count() == 3


def test_sparse_colours_and_background_agree_with_dense_images(spark):
    rng = np.random.default_rng(1)
    counts = np.where(rng.random((4, 8)) < 0.4, rng.integers(1, 50, (4, 8)), 0).astype(float)
    cells = [("a", "chr1", 0, 0, int(r), int(c), float(counts[r, c])) for r, c in zip(*np.nonzero(counts))]
    df = spark.createDataFrame(cells, "accession string, chrom string, rs int, cs int, row int, col int, value float")
    want = image.image_batch(counts[None], np.array([False]))[0]
    rgb = image.contact_rgb(df)
    back = image.imagenet_normalize(image.background(rgb)).first()
    got = np.empty((3, 4, 8))
    got[:] = np.array([back.red, back.green, back.blue])[:, None, None]
    for p in image.imagenet_normalize(rgb).collect():
        got[:, p.row, p.col] = p.red, p.green, p.blue
    assert np.allclose(got, want, atol=1e-9)


def test_flag_of_an_empty_window_blackens_stored_cells(spark):
    df = spark.createDataFrame([("a", 0, 0, 5.0, True)], "accession string, row int, col int, value double, is_empty boolean")
    row = image.contact_rgb(df, ("accession",)).first()
    assert (row.red, row.green, row.blue) == (0.0, 0.0, 0.0)


def test_resumed_run_commits_only_what_is_missing(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = random_contacts(rng, "a", "chr1", 40, 300) + random_contacts(rng, "b", "chr1", 40, 300) + [("none", "chr9", "chr9", 1, 2, 3.0)]
    raw = spark.createDataFrame(rows, RAW)
    bed = spark.createDataFrame([region(0, "chr1", 3, 5, "+"), region(1, "chr1", 9, 9, "-")], BED)
    listed = spark.createDataFrame([(x,) for x in ("a", "b", "none", "unseen")], "accession string")
    path = str(tmp_path / "store")

    def run():
        return sorted(map(tuple, pipelines.resume_windows(raw, bed, listed, path, 1, 4, 8).collect()))

    assert run() == [("a", 2), ("b", 2), ("none", 0)]
    whole = sorted(map(str, spark.read.parquet(path).collect()))
    assert run() == []
    writers.drop_partition(spark, path, "accession", "b")
    assert run() == [("b", 2)]
    # A run that broke off before its marker is done again.
    writers.drop_partition(spark, f"{path}/_done", "accession", "a")
    assert run() == [("a", 2)] and run() == []
    assert sorted(map(str, spark.read.parquet(path).collect())) == whole


def test_assemble_counts_hot_windows_on_their_factors(spark):
    """The same rows whether windows asked for often are salted or not."""
    bios = spark.createDataFrame([(k, "a" if k < 5 else "b") for k in range(7)], "bio_idx bigint, accession string")
    regs = spark.createDataFrame([(k, "chr1", k // 4, 0, f"w{k // 4}") for k in range(12)], "bedpe_idx bigint, chrom string, rs bigint, cs bigint, submat_key string")
    kinds = "accession string, submat_key string, row array<smallint>, col array<smallint>, data array<float>, total_count double"
    records = spark.createDataFrame([("a", "w0", [1], [2], [3.0], 9.0), ("b", "w1", [0], [0], [1.0], 4.0)], kinds)
    counts = {(r.accession, r.submat_key): r["_n"] for r in windows._pair_counts(bios, regs, 7).collect()}
    assert counts[("a", "w0")] == 20 and counts[("b", "w2")] == 8
    got = [sorted(map(str, windows.assemble(bios, regs, records, hot_rows=hot).collect())) for hot in (7, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 84


def store_rows():
    rng = np.random.default_rng(11)
    rows = random_contacts(rng, "a", "chr1", 200, 3000) + random_contacts(rng, "b", "chr1", 120, 1500) + random_contacts(rng, "a", "chr2", 90, 900)
    # Below the diagonal, repeated, and on a chromosome no window lies on.
    return rows + [("a", "chr1", "chr1", 150, 3, 4.0), ("a", "chr1", "chr1", 150, 3, 4.0), ("b", "3", "3", 50, 60, 1.0), ("a", "chr1", "chr2", 1, 1, 9.0)]


STORE_BED = [region(0, "chr1", 3, 5, "+"), region(1, "chr1", 62, 60, "-"), region(2, "chr2", 85, 80, "-"), region(3, "chr1", 148, 0, "+"), region(4, "chr1", 3, 5, "-")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_windows_of_a_contact_store_equal_those_of_the_contacts(spark, tmp_path, most):
    raw, bed = spark.createDataFrame(store_rows(), RAW), spark.createDataFrame(STORE_BED, BED)
    path = str(tmp_path / "store")
    pipelines.store_contacts(raw, path, 1, 16)
    job = pipelines.stored_windows(spark, path, bed, 1, 4, 8, most)
    plain = pipelines.contact_windows(raw, bed, 1, 4, 8)

    def whole(j):
        cells = j.cells.select("accession", "chrom", "rs", "cs", "row", "col", "value")
        return [sorted(map(str, df.collect())) for df in (cells, pipelines.window_summary(j), j.totals)]

    assert whole(job) == whole(plain) and len(whole(plain)[0]) > 10


def scanned_partitions(df):
    """Partitions that the scan of the contact store read, from the metrics of the plan that ran."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec" and "block" in node.output().mkString():
            if node.metrics().contains("numPartitions"):
                found.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_a_store_job_reads_only_the_blocks_in_use(spark, tmp_path):
    raw, bed = spark.createDataFrame(store_rows(), RAW), spark.createDataFrame(STORE_BED[:2], BED)
    path = str(tmp_path / "store")
    pipelines.store_contacts(raw, path, 1, 16)
    every = spark.read.parquet(path).select("accession", "block").distinct().count()
    touched = pipelines.stored_windows(spark, path, bed, 1, 4, 8).touched
    assert "dynamicpruning" in touched._jdf.queryExecution().toString()
    used = touched.select("accession", "block").distinct().count()
    assert scanned_partitions(touched) == used < every / 3


def test_a_store_keeps_other_accessions_and_drops_old_blocks(spark, tmp_path):
    path = str(tmp_path / "store")
    pipelines.store_contacts(spark.createDataFrame([("a", "1", "1", 0, 90, 1.0), ("b", "1", "1", 5, 5, 2.0)], RAW), path, 1, 16)
    pipelines.store_contacts(spark.createDataFrame([("a", "1", "1", 1, 2, 7.0)], RAW), path, 1, 16)
    stored, stats = readers.read_tiled_contacts(spark, path)
    assert {(r.accession, r.block, r.row, r.col, r.value) for r in stored.collect()} == {("a", "chr1.0.0", 1, 2, 7.0), ("b", "chr1.0.0", 5, 5, 2.0)}
    assert {(r.accession, r.chrom1, r.max_col, r.total) for r in stats.collect()} == {("a", "chr1", 2, 7.0), ("b", "chr1", 5, 2.0)}
    with pytest.raises(ValueError, match="resolution"):
        pipelines.stored_windows(spark, path, spark.createDataFrame([], BED), 5)
    with pytest.raises(ValueError, match="two ways"):
        pipelines.store_contacts(spark.createDataFrame([("a", "1", "1", 0, 9, 1.0), ("a", "chr1", "chr1", 5, 5, 2.0)], RAW), path, 1, 16)


def test_store_blocks_are_fine_along_the_diagonal(spark):
    cells = spark.createDataFrame([("a", "c", r, c, 1.0) for r, c in [(0, 0), (15, 16), (16, 0), (0, 47), (0, 48), (200, 0)]], "accession string, chrom1 string, row int, col int, value double")
    assert [r.block for r in contacts.with_block(cells, 16).collect()] == ["c.0.0", "c.0.1", "c.0.1", "c.0.1", "c.0.2", "c.0.3"]


KINDS = "accession string, submat_key string, row array<smallint>, col array<smallint>, data array<float>, total_count double"
REGS = "bedpe_idx bigint, chrom string, rs bigint, cs bigint, submat_key string, token_text string"


def pairing_inputs(spark):
    """Repeated windows, a biosample without a store, two of one accession, a stored window nobody asks for."""
    bios = spark.createDataFrame([(0, "a"), (1, "b"), (2, "none"), (3, "a")], "bio_idx bigint, accession string")
    regs = spark.createDataFrame([(k, "chr1", k // 4, 0, f"w{k // 4}", f"t{k}" * 50) for k in range(14)], REGS)
    stored = [("a", "w0", [1], [2], [3.0], 9.0), ("a", "w1", [], [], [], 9.0), ("b", "w1", [0], [0], [1.0], 4.0), ("b", "w9", [0], [0], [1.0], 4.0)]
    return bios, regs, spark.createDataFrame(stored, KINDS)


@pytest.mark.parametrize("hot", [10**6, 3])
def test_colocated_rows_equal_the_assembled_ones(spark, hot):
    bios, regs, records = pairing_inputs(spark)
    got = windows.colocated_rows(bios, regs, records, 4, hot)
    want = windows.assemble(bios, regs.drop("token_text"), records).join(regs.select("bedpe_idx", "token_text"), "bedpe_idx").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 56


def moved_columns(node):
    """Output columns of every shuffle of a plan that ran."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved_columns(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return moved_columns(node.plan())
    children = node.children()
    found = [x for i in range(children.size()) for x in moved_columns(children.apply(i))]
    return found + [node.output().mkString(",")] if kind == "ShuffleExchangeExec" else found


def test_bucketed_windows_and_sequences_meet_without_an_exchange(spark):
    rows = windows.colocated_rows(*pairing_inputs(spark), 4)
    assert rows.rdd.getNumPartitions() == 8
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    assert "SelectedBucketsCount: 4 out of 4" in plan.toString()
    assert not any(name in columns for columns in moved_columns(plan) for name in ("token_text", "data#"))
    plain = windows.assemble(*pairing_inputs(spark)).repartition(3, "submat_key")
    plain.collect()
    assert any("data#" in columns for columns in moved_columns(plain._jdf.queryExecution().executedPlan()))


def test_window_models_run_once_a_window(spark):
    """Against a prediction of every item: shared, missing and flagged windows, and an accession without any."""
    from chromaloom.operators import infer
    from chromaloom.plans import features

    biosamples = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "none")], "bio_idx bigint, accession string")
    regions = spark.createDataFrame(
        [(i, "chr1", 0, i % 3, f"chr1:0,{i % 3}") for i in range(7)], "bedpe_idx bigint, chrom string, rs bigint, cs bigint, submat_key string"
    )
    record = "accession string, submat_key string, row array<smallint>, col array<smallint>, data array<float>, is_empty boolean, total_count double"
    stored = [("a", "chr1:0,0", [0, 1], [0, 3], [1.0, 9.0], False, 50.0), ("a", "chr1:0,1", [0], [1], [3.0], True, 50.0), ("b", "chr1:0,2", [1], [2], [4.0], False, 7.0)]
    stored = spark.createDataFrame(stored, record)
    items = windows.assemble(biosamples, regions, stored, partitions=3)
    keys = ("bio_idx", "bedpe_idx")
    want = infer.predict(items, features.contact_model, keys, "contact", 2, 4, dtype="float64")
    got = infer.predict_windows(biosamples, regions, stored, features.contact_model, 2, 4, dtype="float64")
    plain = lambda df: sorted((r.bio_idx, r.bedpe_idx, round(r.y[0], 12)) for r in df.collect())
    assert len(plain(got)) == 28 and plain(got) == plain(want)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_attributions_are_written_where_they_are_made(spark, tmp_path):
    """Neither an exchange nor a sort carries the arrays, the session's setting is as before, and sums are read back."""
    from chromaloom.operators import infer
    from chromaloom.sources import writers

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = [("a", 0, [1.0, 2.5], [0.5]), ("b", 1, [], [4.0]), ("a", 2, [3.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "accession string, bedpe_idx bigint, seq_attr array<double>, hic_attr array<double>").repartition(3)
    for _ in range(2):
        writers.write_attributions(df, str(tmp_path / "store"))
    assert spark.conf.get(name) == before
    sums = infer.array_totals(spark.read.parquet(str(tmp_path / "store")), seq_total="seq_attr", hic_total="hic_attr")
    assert sorted((r.accession, r.bedpe_idx, r.seq_total, r.hic_total) for r in sums.collect()) == [("a", 0, 3.5, 0.5), ("a", 2, 3.0, 2.0), ("b", 1, 0.0, 4.0)]
    assert len(list((tmp_path / "store" / "accession=a").glob("*.parquet"))) == 2


def test_repeated_windows_of_a_batch_are_drawn_once():
    import numpy as np
    import pyarrow as pa

    from chromaloom.operators import infer

    data = [[1.0, 2.0], [1.0, 2.0], [], [1.0, 2.0], []]
    batch = pa.RecordBatch.from_pydict({
        "row": pa.array([[0, 1] if d else [] for d in data], pa.list_(pa.int16())), "col": pa.array([[0, 1] if d else [] for d in data], pa.list_(pa.int16())),
        "data": pa.array(data, pa.list_(pa.float32())), "is_empty": [False, False, True, True, True], "total_count": [1.0, 2.0, 3.0, 4.0, 5.0],
    })
    assert infer.repeated_windows(batch) == ([0, 2, 3], [0, 0, 1, 2, 1])
    assert infer.repeated_windows(batch.slice(1)) == ([0, 1, 2], [0, 1, 2, 1])
    img, total = infer.batch_inputs(batch, "contact", 2, 2, "float64")
    alone = np.concatenate([infer.batch_inputs(batch.slice(i, 1), "contact", 2, 2, "float64")[0] for i in range(5)])
    assert (img == alone).all() and total.tolist() == [1, 2, 3, 4, 5]
