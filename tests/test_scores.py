import math

import numpy as np
import pandas as pd
import pytest

from chromaloom.operators import labels, metrics, ranks, skew
from chromaloom.sources.readers import organism_filter


def scores(spark, rng, n, keys=("a", "b")):
    rows = [(k, i, float(rng.integers(0, 9)), float(rng.integers(0, 9)) + rng.random() * (i % 2)) for k in keys for i in range(n)]
    return pd.DataFrame(rows, columns=["accession", "gene_idx", "y", "y_hat"]), spark.createDataFrame(
        rows, "accession string, gene_idx bigint, y double, y_hat double"
    )


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_ranks_match_pandas_over_any_ranges(spark, buckets):
    pdf, df = scores(spark, np.random.default_rng(0), 300)
    got = ranks.value_ranks(df, ["accession"], "y_hat", buckets=buckets).toPandas()
    got["rank"] = got["before"] + (got["n"] + 1) / 2
    want = pdf.assign(rank=pdf.groupby("accession")["y_hat"].rank())
    merged = want.merge(got, on=["accession", "y_hat"])
    assert len(merged) == len(pdf) and np.array_equal(merged["rank_x"], merged["rank_y"])
    assert set(got["total"]) == {300}


def test_ranks_without_keys_over_buckets(spark):
    pdf, df = scores(spark, np.random.default_rng(1), 200)
    got = ranks.value_ranks(df, [], "y_hat", buckets=5).toPandas()
    merged = pdf.assign(rank=pdf["y_hat"].rank()).merge(got, on="y_hat")
    assert np.array_equal(merged["rank"], merged["before"] + (merged["n"] + 1) / 2)


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 5])
def test_spearman_and_pearson_match_pandas(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew.join_unique, "__defaults__", ("inner", hot_rows))
    pdf, df = scores(spark, np.random.default_rng(2), 250)
    by_key = {k: g for k, g in pdf.groupby("accession")}
    got = {r.accession: r.spearman for r in metrics.spearman(df).collect()}
    for key, g in by_key.items():
        assert math.isclose(got[key], g["y"].rank().corr(g["y_hat"].rank()), abs_tol=1e-12)
    assert math.isclose(metrics.spearman(df, ()).first().spearman, pdf["y"].rank().corr(pdf["y_hat"].rank()), abs_tol=1e-12)
    assert math.isclose(metrics.pearson(df, ()).first().pearson, pdf["y"].corr(pdf["y_hat"]), abs_tol=1e-12)


def test_a_constant_column_gives_null_or_nan(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 3.0), ("a", 1, 2.0, 3.0)], "accession string, gene_idx bigint, y double, y_hat double")
    assert metrics.pearson(df).first().pearson is None
    assert metrics.spearman(df).first().spearman is None
    assert math.isnan(metrics.pearson(df, strict=True).first().pearson)
    assert math.isnan(metrics.mean_score(metrics.spearman(df, strict=True), "spearman").first().mean_spearman)


def test_mse_with_and_without_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, 1.0), ("a", 2.0, 2.0, 3.0)], "accession string, y double, y_hat double, w double")
    assert metrics.mse(df).first().mse == 2.0
    assert metrics.mse(df, ["accession"], "w").first().mse == 1.0


def test_best_run(spark):
    df = spark.createDataFrame([(0.1, 3.0), (0.2, 1.0), (0.3, 2.0)], "reg double, val_loss double")
    assert metrics.best_run(df).first().reg == 0.2


def profile_rows(values):
    return [(acc, g, float(y)) for acc, ys in values.items() for g, y in enumerate(ys) if not math.isnan(y)]


def test_similarity_over_shared_genes_and_blocks(spark):
    rng = np.random.default_rng(3)
    values = {f"t{i}": rng.random(50) for i in range(3)} | {f"r{i}": rng.random(50) for i in range(4)}
    values["t0"][:10] = np.nan
    values["r1"][5:15] = np.nan
    expr = spark.createDataFrame(profile_rows(values), "accession string, gene_idx bigint, y double")
    side = lambda p: spark.createDataFrame([(k,) for k in values if k[0] == p], "accession string")
    got = {(r.test, r.train): r.similarity for r in metrics.expression_similarity(expr, side("t"), side("r"), 8).collect()}
    assert len(got) == 12
    for (t, r), value in got.items():
        assert math.isclose(value, pd.Series(values[t]).corr(pd.Series(values[r])), abs_tol=1e-12)


def test_imputation_takes_the_most_similar_profile(spark):
    values = {"t": [1, 2, 3, 4.0], "same": [2, 4, 6, 8.0], "also": [2, 4, 6, 8.0], "other": [4, 1, 3, 2.0], "flat": [1, 1, 1, 1.0]}
    expr = spark.createDataFrame(profile_rows(values), "accession string, gene_idx bigint, y double")
    preds = expr.selectExpr("accession", "gene_idx", "y * 10 AS y_hat")
    train = spark.createDataFrame([("same",), ("also",), ("other",), ("flat",)], "accession string")
    got = metrics.impute_from_nearest(expr, preds, spark.createDataFrame([("t",)], "accession string"), train).collect()
    assert {(r.accession, r.source, r.gene_idx, r.y_hat) for r in got} == {("t", "also", g, y * 10) for g, y in enumerate(values["also"])}


EXPR = "rna_accession string, gene_id string, tpm double"
PAIRS = "rna_accession string, hic_accession string"
GENES = "gene_idx bigint, gene_id string, chrom string"


def label_inputs(spark, expr):
    pairs = spark.createDataFrame([("R1", "H1"), ("R2", "H2")], PAIRS)
    genes = spark.createDataFrame([(0, "G0", "chr1"), (1, "G1", "chr4"), (2, "G2", "chr11"), (3, "G3", "chr1"), (4, "G0", "chr5")], GENES)
    return spark.createDataFrame(expr, EXPR), pairs, genes


FULL = [(r, g, float(i)) for r in ("R1", "R2", "R9") for i, g in enumerate(["G0", "G1", "G2"])] + [("R1", "G3", 1.0)]


def test_labels_keep_genes_of_every_file_and_repeat_annotation_rows(spark):
    got = labels.label_join(*label_inputs(spark, FULL)).collect()
    assert {(r.accession, r.gene_idx, r.seq_split, round(2**r.y - 1, 9)) for r in got} == {
        (acc, g, s, t) for acc in ("H1", "H2") for g, s, t in [(0, "train", 0.0), (4, "test", 0.0), (1, "val", 1.0), (2, "test", 2.0)]
    }


def test_missing_labels_are_refused(spark):
    for bad in (None, float("nan")):
        expr = [r for r in FULL if r[:2] != ("R1", "G1")] + [("R1", "G1", bad)]
        with pytest.raises(Exception, match="contains nan values"):
            labels.label_join(*label_inputs(spark, expr)).collect()


def test_two_files_for_one_accession_are_refused_and_repeated_genes_multiply(spark):
    expr, _, genes = label_inputs(spark, FULL)
    pairs = spark.createDataFrame([("R1", "H1"), ("R2", "H1")], PAIRS)
    with pytest.raises(ValueError, match="two expression files"):
        labels.label_join(expr, pairs, genes)
    once = labels.label_join(*label_inputs(spark, FULL)).count()
    again = labels.label_join(*label_inputs(spark, FULL + [("R1", "G0", 2.0)]))
    assert again.count() == once + 2  # the gene has two annotation rows


def test_listed_biosamples_without_expression_get_zeros(spark):
    long = labels.label_join(*label_inputs(spark, FULL))
    splits = spark.createDataFrame([("train", 0, "H1"), ("train", 1, "ghost"), ("test", 0, "H2")], "split string, bio_idx bigint, accession string")
    split = labels.biosample_split_join(long, splits)
    rows = split.collect()
    assert len(rows) == 12
    assert {(r.y, r.is_missing) for r in rows if r.accession == "ghost"} == {(0.0, True)}
    assert not any(r.is_missing for r in rows if r.accession != "ghost")
    sizes = {(r.seq_split, r.bio_split): (r.n_bios, r.n_seqs) for r in labels.split_sizes(split).collect()}
    assert sizes["test", "train"] == (2, 2) and sizes["val", "test"] == (1, 1)
    matrix = {(r.seq_split, r.bio_split, r.bio_idx, r["first"]): r["values"] for r in labels.label_matrix(split, block=1).collect()}
    assert matrix["test", "test", 0, 1] == [0.0] and len(matrix) == 12


def test_organisms(spark):
    df = spark.createDataFrame([("human",), ("mouse",), ("Human",)], "organism string")
    assert organism_filter(df).count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_any_other(spark, how):
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)], "i bigint, k string")
    one = spark.createDataFrame([("hot", 1.0), ("k0", 2.0), ("k3", 3.0)], "k string, v double")
    plain = sorted(map(str, many.join(one, "k", how).select("i", "k", "v").collect()))
    hot = skew.join_unique(many, one, ["k"], how, hot_rows=10).select("i", "k", "v")
    assert sorted(map(str, hot.collect())) == plain


@pytest.mark.parametrize("block_rows", [1000, 4])
def test_pairing_is_complete(spark, block_rows):
    few = spark.createDataFrame([(i,) for i in range(9)], "b bigint")
    many = spark.createDataFrame([(i,) for i in range(11)], "m bigint")
    pairs = skew.pair_all(few, many, "b", block_rows)
    assert pairs.count() == 99 and pairs.distinct().count() == 99
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_hold_values_in_order(spark):
    df = spark.createDataFrame([("x", i, float(i)) for i in reversed(range(10))], "k string, p bigint, v double")
    got = {r["first"]: r["values"] for r in ranks.vector_blocks(df, ["k"], "p", "v", 4).collect()}
    assert got == {0: [0.0, 1.0, 2.0, 3.0], 4: [4.0, 5.0, 6.0, 7.0], 8: [8.0, 9.0]}


def test_scores_leave_out_rows_that_lack_a_side(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 4.0), ("a", None, 100.0), ("a", 50.0, None), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "accession string, y double, y_hat double")
    got = {r["accession"]: r["pearson"] for r in metrics.pearson(df).collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 4])[0, 1]) and got["b"] is None


@pytest.mark.parametrize("profiles", [1024, 1])
def test_similarity_of_large_values_keeps_its_digits(spark, profiles):
    rng = np.random.default_rng(2)
    base = rng.random(40)
    rows = [(name, g, 1e5 + scale * float(base[g])) for name, scale in (("t", 1e-4), ("u", 1e-4), ("v", -1e-4)) for g in range(40)]
    expr = spark.createDataFrame(rows, "accession string, gene_idx bigint, y double")
    test, train = (spark.createDataFrame([(n,) for n in names], "accession string") for names in (["t"], ["u", "v"]))
    got = {r["train"]: r["similarity"] for r in metrics.expression_similarity(expr, test, train, 16, profiles).collect()}
    assert got["u"] == pytest.approx(1, abs=1e-4) and got["v"] == pytest.approx(-1, abs=1e-4)


def test_equal_similarities_go_to_the_first_name(spark):
    rows = [(name, g, float(g)) for name in ("t", "y", "x") for g in range(4)]
    expr = spark.createDataFrame(rows, "accession string, gene_idx bigint, y double")
    test, train = (spark.createDataFrame([(n,) for n in names], "accession string") for names in (["t"], ["y", "x"]))
    preds = expr.withColumnRenamed("y", "y_hat")
    assert {r["source"] for r in metrics.impute_from_nearest(expr, preds, test, train).collect()} == {"x"}


@pytest.mark.parametrize("block_values", [4_000_000, 120, 1])
def test_nearest_profiles_equal_the_best_of_all_pairs(spark, block_values):
    """Blocks of every size; gaps, a constant profile, copies of one training profile, a name on both sides."""
    rng = np.random.default_rng(8)
    values = {f"t{i}": rng.random(40) + 1e4 for i in range(5)} | {f"r{i}": rng.random(40) for i in range(6)}
    values |= {"r7": values["r3"], "r2b": values["r3"], "flat": np.ones(40)}
    values["t1"] = values["r3"] * 3 + 1
    values["t0"][:10] = values["r1"][5:15] = np.nan
    expr = spark.createDataFrame(profile_rows(values), "accession string, gene_idx bigint, y double")
    side = lambda names: spark.createDataFrame([(n,) for n in names], "accession string")
    tests, trains = ["t0", "t1", "t2", "t3", "t4", "r0", "flat", "unheard"], ["r0", "r1", "r2", "r2b", "r3", "r4", "r5", "r7", "flat"]
    got = {r.test: (r.train, r.similarity) for r in metrics.nearest_profiles(expr, side(tests), side(trains), block_values).collect()}
    assert set(got) == {"t0", "t1", "t2", "t3", "t4", "r0"}
    for t, (train, similarity) in got.items():
        plain = {r: pd.Series(values[t]).corr(pd.Series(values[r])) for r in trains if r != "flat"}
        assert train == min(plain, key=lambda r: (-round(plain[r], 9), r))
        assert math.isclose(similarity, plain[train], abs_tol=1e-9)
    assert got["t1"][0] == "r2b" and got["r0"][0] == "r0"


def test_nearest_profiles_without_a_side(spark):
    expr = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 3.0)], "accession string, gene_idx bigint, y double")
    none = spark.createDataFrame([], "accession string")
    assert metrics.nearest_profiles(expr, spark.createDataFrame([("t",)], "accession string"), none).collect() == []
