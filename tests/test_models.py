import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.functions import numeric
from chromaloom.operators import decoder, fusion, image, infer, perturb, sequence
from chromaloom.plans import features
from chromaloom.sources import fasta

RECORD = "accession string, submat_key string, row array<smallint>, col array<smallint>, data array<float>, is_empty boolean, total_count double"
TARGET = "target_idx bigint, submat_key string, r0 bigint, r1 bigint, c0 bigint, c1 bigint, seq_row bigint"
H, W, OFFSET, BANDS = 4, 8, 2, 5


def records(spark):
    return spark.createDataFrame(
        [("a", "chr1:0,0", [0, 1, 3], [0, 2, 7], [1.0, 2.0, float("inf")], False, 50.0), ("a", "chr1:5,0", [], [], [], True, 50.0)], RECORD
    )


def bands(spark):
    return spark.createDataFrame([(k, 0.5 + k) for k in range(BANDS)], "k bigint, value double")


def grids(df):
    out = {}
    for r in df.collect():
        key = (r.target_idx, r.variant if "variant" in r else None)
        out.setdefault(key, np.zeros((H, W)))[r.row, r.col] += r.value
    return out


def expected_matrix():
    r, c = np.arange(H)[:, None], np.arange(W)[None, :]
    return 0.5 + np.clip(np.abs(c - r - OFFSET), 0, BANDS - 1)


TARGETS = [(0, "chr1:0,0", 0, 2, 1, 4, 0), (1, "chr1:5,0", 1, 9, 6, 99, 1), (2, "chr1:0,0", 2, 2, 0, 8, 1)]


@pytest.mark.parametrize("fill", ["k_expected", "zeros"])
def test_blocks_are_half_open_and_filled_everywhere(spark, fill):
    pairs = perturb.perturbation_pairs(spark.createDataFrame(TARGETS, TARGET), records(spark))
    got = grids(perturb.perturb(pairs, bands(spark), fill, H, W, OFFSET, BANDS))
    base = np.zeros((H, W))
    base[0, 0], base[1, 2], base[3, 7] = 1, 2, np.float32(3.4028235e38)
    for i, key, r0, r1, c0, c1, _ in TARGETS:
        want = base.copy() if key == "chr1:0,0" else np.zeros((H, W))
        want[r0:r1, c0:c1] = expected_matrix()[r0:r1, c0:c1] if fill == "k_expected" else 0
        assert np.allclose(got.get((i, None), np.zeros((H, W))), want), i


def test_an_empty_original_blackens_its_edited_version(spark):
    pairs = perturb.perturbation_pairs(spark.createDataFrame(TARGETS, TARGET), records(spark))
    edited = perturb.perturb_records(pairs, perturb.expectation(bands(spark), BANDS), "k_expected", H, W, OFFSET)
    images = perturb.paired_images(pairs, edited, H, W)
    black = (0 - 0.485) / 0.229
    rows = images.where("target_idx = 1").collect()
    assert rows and all(abs(r.red - black) < 1e-12 for r in rows)
    assert all(r.red > 0 for r in images.where("target_idx = 0").collect())


def test_unknown_windows_and_fills_are_refused(spark):
    lost = spark.createDataFrame([(0, "chr9:0,0", 0, 1, 0, 1, 0)], TARGET)
    with pytest.raises(Exception, match="missing window chr9:0,0"):
        perturb.perturbation_pairs(lost, records(spark)).collect()
    with pytest.raises(ValueError):
        perturb.perturb_records(lost, None, "other")
    with pytest.raises(ValueError):
        perturb.perturb_records(lost, None, "k_expected")


def test_target_descriptions_have_defaults(spark):
    bare = spark.createDataFrame(TARGETS[:1], TARGET)
    row = perturb.target_meta(bare).first()
    assert (row.gene_symbol, row.element_id, row.regulated) == ("", "", -1)
    named = bare.withColumns({"loop_id": F.lit(7), "Regulated": F.lit(1)})
    row = perturb.target_meta(named).first()
    assert (row.element_id, row.regulated) == ("7", 1)
    assert perturb.target_meta(named.withColumn("enhancer_id", F.lit("e"))).first().element_id == "e"


def test_predictions_must_match_their_targets(spark):
    targets = spark.createDataFrame(TARGETS, TARGET)
    preds = spark.createDataFrame([(0, 1.0), (1, 2.0)], "target_idx bigint, y double")
    with pytest.raises(Exception, match="differ in rows"):
        perturb.attach_predictions(targets, preds).collect()
    assert perturb.attach_predictions(targets.where("target_idx < 2"), preds).count() == 2


def test_scores_of_both_versions(spark):
    tokens = spark.createDataFrame([(0, "0123"), (1, "..44")], "region_idx bigint, token_text string")
    pairs = perturb.perturbation_pairs(spark.createDataFrame(TARGETS, TARGET), records(spark), tokens)
    edited = perturb.perturb_records(pairs, perturb.expectation(bands(spark), BANDS), "k_expected", H, W, OFFSET)
    got = {r.target_idx: r for r in perturb.score_pairs(pairs, edited, features.joint_model, H, W, dtype="float64").collect()}
    assert len(got) == 3
    assert got[1].delta == 0 and got[2].delta == 0 and got[0].delta != 0
    assert abs(got[0].delta - (got[0].y_pert - got[0].y_orig)) < 1e-12


def model_rows(spark):
    rows = [(i, "0123"[i:] + "." * i, [0, 3], [0, 7], [float(i), 4.0], i == 2, 10.0 * i) for i in range(4)]
    return spark.createDataFrame(rows, "bedpe_idx bigint, token_text string, row array<smallint>, col array<smallint>, data array<float>, is_empty boolean, total_count double")


def test_joint_prediction_matches_numpy_for_any_batch_size(spark):
    fn = features.joint_model()
    for batch in (1, 3, 10):
        got = {r.bedpe_idx: r.y[0] for r in infer.predict(model_rows(spark), features.joint_model, ("bedpe_idx",), "joint", H, W, batch, "float64").collect()}
        for i in range(4):
            dense = np.zeros((1, H, W))
            dense[0, 0, 0], dense[0, 3, 7] = i, 4
            img = image.image_batch(dense, np.array([i == 2]))
            onehot = np.array([[[float(c == str(b)) for b in range(4)] if c != "." else [0.25] * 4 for c in "0123"[i:] + "." * i]])
            assert abs(got[i] - fn(onehot, img, np.array([10.0 * i]))[0]) < 1e-12


def test_sequence_only_model_has_one_row_per_biosample(spark):
    preds = infer.predict(model_rows(spark), features.sequence_model, ("bedpe_idx",), "sequence", partitions=2)
    rows = infer.per_biosample(preds, ("bedpe_idx",)).collect()
    assert {(r.bedpe_idx, r.bio_idx) for r in rows} == {(i, b) for i in range(4) for b in range(3)}


def test_embeddings_are_cropped_and_halved(spark):
    def encoder():
        return lambda seq: np.stack([np.arange(5)[:, None] + np.array([[0.1, 0.2]])] * len(seq))

    row = infer.embed_sequences(model_rows(spark), encoder, 2, ("bedpe_idx",)).first()
    assert row.vec == [float(np.float16(v)) for v in (1.1, 1.2, 2.1, 2.2)]
    with pytest.raises(Exception, match="cannot crop 5"):
        infer.embed_sequences(model_rows(spark), encoder, 6, ("bedpe_idx",)).collect()


def test_contact_grids_drop_leading_tokens_and_crop(spark):
    def encoder():
        return lambda img, total: np.stack([np.arange(-2, 12, dtype=float)[:, None]] * len(img))

    got = infer.embed_contacts(model_rows(spark), encoder, (3, 4), (1, 2), H, W, ("bedpe_idx",)).where("bedpe_idx = 0")
    assert {(r.r, r.c, r.vec[0]) for r in got.collect()} == {(0, 0, 5.0), (0, 1, 6.0)}
    with pytest.raises(ValueError):
        infer.embed_contacts(model_rows(spark), encoder, (3, 4), (4, 4), H, W)
    with pytest.raises(Exception, match="patch tokens"):
        infer.embed_contacts(model_rows(spark), encoder, (3, 5), (1, 2), H, W, ("bedpe_idx",)).collect()


def test_attribution_is_input_times_gradient(spark):
    rows = infer.input_x_gradient(model_rows(spark), features.joint_gradient, ("bedpe_idx",), H, W, dtype="float64").collect()
    preds = {r.bedpe_idx: r.y[0] for r in infer.predict(model_rows(spark), features.joint_model, ("bedpe_idx",), "joint", H, W, dtype="float64").collect()}
    for r in rows:
        assert len(r.seq_attr) == 16 and len(r.hic_attr) == 3 * H * W
        total = sum(r.seq_attr) + sum(r.hic_attr) + 0.1 * np.log10(10.0 * r.bedpe_idx + 1)
        assert abs(total - preds[r.bedpe_idx]) < 1e-9
    with pytest.raises(ValueError):
        infer.predict(model_rows(spark), features.joint_model, kind="other")


def test_fused_features_match_numpy(spark):
    rng = np.random.default_rng(0)
    R, C, D = 2, 4, 3
    hic = rng.normal(size=(2, 2, R, C, D))
    hic_df = spark.createDataFrame(
        [(b, m, r, c, hic[b, m, r, c].tolist()) for b in range(2) for m in range(2) for r in range(R) for c in range(C)],
        "b bigint, m bigint, r bigint, c bigint, vec array<double>",
    )
    ln = lambda x: (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    for mode, ratio, norm in (("cols", 2, True), ("rows", 4, True), ("rows", 4, False)):
        bins = rng.normal(size=(2, 8, D))
        bins_df = spark.createDataFrame([(m, i, bins[m, i].tolist()) for m in range(2) for i in range(8)], "m bigint, bin int, vec array<double>")
        pooled = bins.reshape(2, 8 // ratio, ratio, D).mean(2)
        row = pooled[:, 1:3] if mode == "cols" else pooled
        seq = row[:, :, None] + pooled[:, None]
        if norm:
            seq = ln(seq)
        if mode == "rows":
            seq = np.pad(seq, ((0, 0), (0, 0), (1, 1), (0, 0)))
        want = (ln(hic) if norm else hic) + 0.5 * seq[None]
        got = np.zeros_like(hic)
        n = 0
        for x in fusion.fused_features(hic_df, bins_df, R, C, ratio, mode, 0.5, norm).collect():
            got[x.b, x.m, x.r, x.c] = x.vec
            n += 1
        assert n == 32 and np.allclose(got, want, atol=1e-9), mode


def test_fusion_contracts(spark):
    bins = spark.createDataFrame([(0, i, [1.0]) for i in range(6)], "m bigint, bin int, vec array<double>")
    with pytest.raises(Exception, match="expected bins 0 to 3"):
        fusion.align_bins(bins, 2, 2, 2, "cols").collect()
    with pytest.raises(ValueError, match="expected 8 bins"):
        fusion.check_bin_count(bins, 8)
    with pytest.raises(ValueError, match="even"):
        fusion.align_bins(bins, 1, 2, 3, "cols")
    with pytest.raises(ValueError, match="unknown mode"):
        fusion.align_bins(bins, 1, 2, 3, "diag")
    with pytest.raises(ValueError):
        fusion.center_crop_2d(bins, 3, 1, 2, 2)


def test_odd_surplus_of_columns_goes_right(spark):
    grid = spark.createDataFrame([(0, r, c, [1.0]) for r in range(2) for c in range(2)], "m bigint, r bigint, c bigint, vec array<double>")
    got = {(x.r, x.c): x.vec[0] for x in fusion.pad_columns(grid, 2, 5, -1.0).collect()}
    assert got == {(r, c): (1.0 if c in (1, 2) else -1.0) for r in range(2) for c in range(5)}


def test_training_rows_and_their_checks(spark):
    hic = spark.createDataFrame([(b, m, [float(b), float(m)]) for b in range(2) for m in range(3)], "b bigint, m bigint, vec array<double>")
    seq = spark.createDataFrame([(m, [float(m)]) for m in range(3)], "m bigint, vec array<double>")
    y = spark.createDataFrame([(b, m, b + m / 10) for b in range(2) for m in range(3)], "b bigint, m bigint, y double")
    fusion.check_training_shapes(hic, seq, y)
    rows = fusion.training_rows(hic, seq, y).collect()
    assert len(rows) == 6 and {r.w for r in rows} == {1.0}
    assert all(r.seq_vec == [float(r.m)] and r.y == float(np.float32(r.b + r.m / 10)) for r in rows)
    with pytest.raises(ValueError, match="different items"):
        fusion.check_training_shapes(hic, seq.where("m < 2"), y)
    with pytest.raises(ValueError, match="do not cover"):
        fusion.check_training_shapes(hic, seq, y.where("b = 0"))
    dims = fusion.store_dims(hic.selectExpr("b", "m", "0L AS r", "0L AS c", "vec"), 4).first()
    assert (dims.n_rows, dims.n_cols, dims.dim, dims.steps) == (1, 1, 2, 2)


def test_decoder_recovers_a_linear_rule(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    rows = spark.createDataFrame([(v.tolist(), float(v @ [1, -2, 0.5] + 3)) for v in x], "vec array<double>, y double")
    model, runs = decoder.fit_decoder(rows, rows, (10.0, 0.0))
    assert np.allclose(model.coefficients.toArray(), [1, -2, 0.5], atol=1e-6) and abs(model.intercept - 3) < 1e-6
    assert {r.reg_param for r in runs.collect()} == {10.0, 0.0}
    assert decoder.score(model, rows).where("abs(y_hat - y) > 1e-6").isEmpty()


def _ridge(x, y, w, strength):
    """Weighted ridge with a free intercept, in one place."""
    total = w.sum()
    mx, my = w @ x / total, w @ y / total
    left = (x - mx).T @ ((x - mx) * w[:, None]) / total + strength * np.eye(x.shape[1])
    b = np.linalg.solve(left, (x - mx).T @ ((y - my) * w[:, None]) / total)
    return b, my - mx @ b


def test_many_outputs_from_one_pass_equal_plain_ridge(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) + 1000
    y = x @ rng.normal(size=(5, 3)) + rng.normal(size=(300, 3)) * 4
    w = rng.integers(0, 4, 300).astype(float)
    split = np.where(np.arange(300) % 3 == 0, "val", np.where(np.arange(300) % 7 == 0, "test", "train"))
    data = [(s, a.tolist(), b.tolist(), float(c)) for s, a, b, c in zip(split, x, y, w)]
    rows = spark.createDataFrame(data, "split string, vec array<double>, ys array<double>, w double").repartition(7)
    found = decoder.moments(rows, "w", fan=3)
    assert set(found) == {"train", "val", "test"}
    for name, own in found.items():
        here = split == name
        z = np.hstack([x, y])[here]
        mean = w[here] @ z / w[here].sum()
        assert own.weight == w[here].sum() and np.allclose(own.mean, mean)
        assert np.allclose(own.products, (z - mean).T @ ((z - mean) * w[here][:, None]))
    model, runs = decoder.fit_outputs(rows, (0.0, 0.5, 50.0), "w")
    train, val = split == "train", split == "val"
    means = {}
    for strength in (0.0, 0.5, 50.0):
        b, base = _ridge(x[train], y[train], w[train], strength)
        losses = w[val] @ (x[val] @ b + base - y[val]) ** 2 / w[val].sum()
        means[strength] = losses.mean()
        got = [r.val_loss for r in sorted(runs.where(f"reg_param = {strength}").collect(), key=lambda r: r.output)]
        assert np.allclose(got, losses, rtol=1e-6)
        if strength == model.strength:
            assert np.allclose(model.coefficients, b, rtol=1e-6) and np.allclose(model.intercepts, base, rtol=1e-6)
    assert model.strength == min(means, key=means.get)
    preds = model.predict(rows.where("split = 'test'")).collect()
    assert all(np.allclose(r.y_hat, np.array(r.vec) @ model.coefficients + model.intercepts) for r in preds)
    scores = {r.output: r for r in decoder.output_scores(model.predict(rows)).collect()}
    for k in range(3):
        y_hat = x @ model.coefficients[:, k] + model.intercepts[k]
        assert scores[k].mse == pytest.approx(np.mean((y_hat - y[:, k]) ** 2)) and scores[k].pearson == pytest.approx(np.corrcoef(y_hat, y[:, k])[0, 1])


def test_decoder_edges(spark):
    schema = "split string, vec array<double>, ys array<double>"
    flat = spark.createDataFrame([("train", [1.0, 2.0], [3.0]), ("train", [2.0, 2.0], [5.0]), ("val", [3.0, 2.0], [7.0])], schema)
    model, _ = decoder.fit_outputs(flat, (0.0,))
    assert np.allclose(model.coefficients, [[2], [0]]) and np.allclose(model.intercepts, [1])
    with pytest.raises(ValueError, match="are needed"):
        decoder.fit_outputs(flat.where("split = 'train'"), (0.0,))
    with pytest.raises(ValueError, match="are needed"):
        decoder.fit_outputs(flat.limit(0), (0.0,))
    ragged = flat.unionByName(spark.createDataFrame([("val", [1.0], [2.0])], schema)).coalesce(1)
    with pytest.raises(Exception, match="of one length"):
        decoder.fit_outputs(ragged, (0.0,))


def test_sequences_match_slices(spark):
    rng = np.random.default_rng(6)
    contigs = {f"c{i}": "".join(rng.choice(list("ACGTNacgt"), n)) for i, n in enumerate([5, 64, 1000])}
    lines = fasta.contig_lines(spark.createDataFrame(list(contigs.items()), "chrom string, seq string"))
    rows = [(i, f"c{i % 3}", int(s), int(s + n), "+-"[i % 2]) for i, (s, n) in enumerate(zip(rng.integers(-60, 1050, 90), rng.integers(0, 21, 90)))]
    bed = spark.createDataFrame(rows, "region_idx bigint, chrom string, start_bp bigint, end_bp bigint, strand string")
    chunks, lengths = fasta.chunk_lines(lines, 50, 20), fasta.contig_lengths(lines)
    got = {r.region_idx: r.token_text for r in sequence.fetch_sequences(bed, chunks, lengths, 20, 50, 20).collect()}
    code = {**{b: str(i) for i, b in enumerate("ACGT")}, **{b: str(i) for i, b in enumerate("acgt")}, "N": "4"}
    for i, chrom, start, end, strand in rows:
        left = start - (20 - (end - start)) // 2
        text = "".join(code[contigs[chrom][p]] if 0 <= p < len(contigs[chrom]) else "." for p in range(left, left + 20))
        if strand == "-":
            text = text[::-1].translate(str.maketrans("0123", "3210"))
        assert got[i] == text, (chrom, start, end, strand)
    with pytest.raises(ValueError, match="overlap"):
        sequence.fetch_sequences(bed, chunks, lengths, 21, 50, 20)
    long = spark.createDataFrame([(0, "c1", 0, 21, "+")], bed.schema)
    with pytest.raises(Exception, match="longer than 20"):
        sequence.fetch_sequences(long, chunks, lengths, 20, 50, 20).collect()
    lost = spark.createDataFrame([(0, "zz", 0, 5, "+")], bed.schema)
    with pytest.raises(Exception, match="no contig zz"):
        sequence.fetch_sequences(lost, chunks, lengths, 20, 50, 20).collect()


def test_token_rows_must_match_regions(spark):
    regions = spark.createDataFrame([(0,), (1,)], "bedpe_idx bigint")
    tokens = spark.createDataFrame([(0, "01"), (1, "23")], "region_idx bigint, token_text string")
    assert sequence.seq_by_region(regions, tokens, 2).count() == 2
    for bad, message in ((tokens.where("region_idx = 0"), "must equal"), (tokens.union(spark.createDataFrame([(2, "00")], tokens.schema)), "must equal")):
        with pytest.raises(Exception, match=message):
            sequence.seq_by_region(regions, bad, 2).collect()
    with pytest.raises(Exception, match="must have 3"):
        sequence.seq_by_region(regions, tokens, 3).collect()


def test_images_of_edited_windows_need_no_gathering(spark):
    """Against ``paired_images``; bounds beyond the window, empty blocks and blocks that hold the largest cell."""
    more = [*TARGETS, (3, "chr1:0,0", 3, 4, 7, 8, 0), (4, "chr1:0,0", -2, 9, -1, 3, 0), (5, "chr1:0,0", 0, 4, 0, 8, 0), (6, "chr1:0,0", 3, 1, 6, 2, 0)]
    targets = spark.createDataFrame(more, TARGET)
    pairs = perturb.perturbation_pairs(targets, records(spark))
    expected = perturb.expectation(bands(spark), BANDS)
    old = perturb.paired_images(pairs, perturb.perturb_records(pairs, expected, "k_expected", H, W, OFFSET), H, W)
    topped = perturb.perturbation_pairs(targets, perturb.edge_tops(records(spark), H, W))
    new = perturb.edited_images(topped, expected, H, W, OFFSET)
    columns = ["target_idx", "variant", "row", "col", "red", "green", "blue"]
    plain = lambda df: sorted((*r[:4], *(round(v, 9) for v in r[4:])) for r in df.select(*columns).collect())
    assert plain(new) == plain(old)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Window" not in plan


def test_scores_come_from_one_row_a_pair(spark):
    tokens = spark.createDataFrame([(0, "0123"), (1, "..44")], "region_idx bigint, token_text string")
    pairs = perturb.perturbation_pairs(spark.createDataFrame(TARGETS, TARGET), records(spark), tokens, 3)
    expected = perturb.expectation(bands(spark), BANDS)
    edited = perturb.perturb_records(pairs, expected, "k_expected", H, W, OFFSET)
    want = {r.target_idx: r for r in perturb.score_pairs(pairs, edited, features.joint_model, H, W, dtype="float64").collect()}
    scored = perturb.score_edits(pairs, expected, features.joint_model, H, W, OFFSET, dtype="float64")
    got = {r.target_idx: r for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i][c] - want[i][c]) < 1e-12 for i in got for c in ("y_orig", "y_pert", "delta"))
    # Windows move by their key only: no exchange by target stands between the join and the model.
    assert "hashpartitioning(accession, target_idx" not in scored._jdf.queryExecution().executedPlan().toString()


def test_rounding_in_plain_arithmetic(spark):
    values = [0.5, -0.5, 2.5, -1.25, 3.4028235e38, float("inf"), float("nan"), -0.0, 1e-9, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.r for r in rows.select(numeric.round_half(F.col("v"), 0).alias("r")).collect()]
    assert got[:6] == [1, -1, 3, -1, 3.4028235e38, float("inf")]
    assert np.isnan(got[6]) and str(got[7]) == "0.0" and got[8] == 0 and got[9] is None
    assert rows.select(numeric.round_half(F.col("v"), 1).alias("r")).collect()[3].r == -1.3
