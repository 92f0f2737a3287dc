import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromaloom.functions import arrays, dna, names, numeric, permute
from chromaloom.operators import fusion


def column(spark, values, kind, expr, name="x"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {name} {kind}")
    return [r.out for r in df.select("i", expr(F.col(name)).alias("out")).orderBy("i").collect()]


HALF_EDGES = [0.0, -0.0, 1.0, 2049.0, 65504.0, 65519.9, 65520.0, 1e9, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 1e-8, 0.1, -0.1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-70000, 70000, width=32), min_size=200, max_size=400))
def test_half_precision_matches_numpy(spark, values):
    values = [float(v) for v in values] + HALF_EDGES
    got = column(spark, values, "double", numeric.to_float16)
    with np.errstate(over="ignore"):
        want = np.array(values).astype(np.float16).astype(np.float64)
    assert np.array_equal(np.array(got), want)


def test_half_precision_then_replacement_of_infinity(spark):
    got = column(spark, [65504.0, 65520.0], "double", lambda x: numeric.nan_to_num(numeric.to_float16(x)))
    assert got == [65504.0, numeric.FLOAT32_MAX]


def test_nan_to_num(spark):
    got = column(spark, [float("nan"), float("inf"), float("-inf"), 2.5], "double", numeric.nan_to_num)
    assert got == [0.0, numeric.FLOAT32_MAX, -numeric.FLOAT32_MAX, 2.5]


def test_log_of_an_empty_total_is_minus_infinity(spark):
    assert column(spark, [0.0, 100.0], "double", numeric.log10_total) == [-math.inf, 2.0]


def test_bins_round_down_below_zero(spark):
    got = column(spark, [-7, 0, 999, 1000], "bigint", lambda x: numeric.bin_index(x, 1000))
    assert got == [-1, 0, 0, 1]


def test_distance_is_held_at_the_last_band(spark):
    df = spark.createDataFrame([(0, 384), (0, 0), (5, 959), (191, 0)], "r int, c int")
    got = [r.k for r in df.select(numeric.distance_index(F.col("r"), F.col("c"), 384, 576).alias("k")).collect()]
    assert got == [0, 384, 570, 575]


def test_placed_chromosomes(spark):
    given_names = ["chr1", "1", "ALL", "chrUn_x", "chrun_x", "chr7_RANDOM", "chr6_alt", "chrX"]
    assert column(spark, given_names, "string", names.is_placed) == [True, True, False, False, True, False, False, True]


def test_prefix_is_case_sensitive(spark):
    assert column(spark, ["1", "chr1", "Chr1"], "string", names.normalize_chrom) == ["chr1", "chr1", "chrChr1"]


def test_biosample_from_path(spark):
    paths = ["/a/b/ENC.pkl", "x.tar.gz", "/a.b/plain", "/a/.hidden", "a..b"]
    assert column(spark, paths, "string", names.biosample_from_path) == ["ENC", "x.tar", "plain", ".hidden", "a."]


def test_submat_key_round_trip(spark):
    df = spark.createDataFrame([("chr1:3", 5, 7)], "chrom string, rs bigint, cs bigint")
    key = names.submat_key(F.col("chrom"), F.col("rs"), F.col("cs"))
    row = df.select(key.alias("key")).select(*[c.alias(n) for n, c in names.parse_submat_key(F.col("key")).items()]).first()
    assert tuple(row) == ("chr1:3", 5, 7)


def test_tokens(spark):
    assert column(spark, ["ACGTNacgtx-"], "string", dna.tokenize) == [[0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 4]]
    assert column(spark, [""], "string", dna.tokenize) == [[]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGTN", max_size=30), min_size=20, max_size=60))
def test_reverse_complement_twice_is_identity(spark, texts):
    once = column(spark, texts, "string", lambda s: dna.reverse_complement_text(dna.token_text(s)))
    want = ["".join({"A": "3", "C": "2", "G": "1", "T": "0", "N": "4"}[b] for b in reversed(t)) for t in texts]
    assert once == want
    twice = column(spark, texts, "string", lambda s: dna.reverse_complement_text(dna.reverse_complement_text(dna.token_text(s))))
    assert twice == column(spark, texts, "string", dna.token_text)
    by_array = column(spark, texts, "string", lambda s: dna.reverse_complement(dna.tokenize(s)))
    assert by_array == [[int(c) for c in t] for t in want]


def test_one_hot_of_other_letters_and_padding(spark):
    got = column(spark, ["03.4"], "string", lambda s: dna.one_hot(dna.token_array(s)))
    assert got == [[[1, 0, 0, 0], [0, 0, 0, 1], [0.25] * 4, [0, 0, 0, 0]]]


def test_padding_survives_the_reverse_complement(spark):
    assert column(spark, ["..01"], "string", dna.reverse_complement_text) == ["23.."]
    assert column(spark, ["..01"], "string", lambda s: dna.reverse_complement(dna.token_array(s))) == [[2, 3, -1, -1]]


def test_center_crop(spark):
    values = [[1.0, 2.0, 3.0, 4.0, 5.0]]
    assert column(spark, values, "array<double>", lambda v: arrays.center_crop_1d(v, 2)) == [[2.0, 3.0]]
    with pytest.raises(Exception, match="cannot crop 5"):
        column(spark, values, "array<double>", lambda v: arrays.center_crop_1d(v, 6))


def test_reshape_needs_a_divisible_length(spark):
    values = [[1.0, 2.0, 3.0, 4.0]]
    assert column(spark, values, "array<double>", lambda v: arrays.reshape_bins(v, 2)) == [[[1.0, 2.0], [3.0, 4.0]]]
    assert column(spark, values, "array<double>", lambda v: arrays.flatten_bins(arrays.reshape_bins(v, 2))) == values
    with pytest.raises(Exception, match="does not divide"):
        column(spark, values, "array<double>", lambda v: arrays.reshape_bins(v, 3))


def test_layer_norm_matches_numpy(spark):
    x = np.array([[0.5, -1.0, 4.0, 2.0], [3.0, 3.0, 3.0, 3.0]])
    want = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    got = column(spark, x.tolist(), "array<double>", arrays.layer_norm)
    assert np.allclose(got, want, atol=1e-12)


def test_flat_index_round_trip(spark):
    df = spark.createDataFrame([(2, 3)], "b bigint, m bigint").select(numeric.flat_index(F.col("b"), F.col("m"), 5).alias("i"))
    b, m = numeric.split_flat_index(F.col("i"), 5)
    assert tuple(df.select("i", b.alias("b"), m.alias("m")).first()) == (13, 2, 3)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 10007])
def test_permutation_holds_every_position_once(spark, n):
    order = spark.range(n).select("id", permute.permuted(F.col("id"), n, 5, 0).alias("p"), permute.permuted(F.col("id"), n, 5, 1).alias("q"))
    got = order.select("*", permute.index_at(F.col("p"), n, 5, 0).alias("back")).collect()
    assert sorted(r.p for r in got) == sorted(r.q for r in got) == list(range(n))
    assert all(r.back == r.id for r in got)
    if n >= 1000:
        assert sum(r.p == r.id for r in got) < 10 and sum(r.p == r.q for r in got) < 10
        ids, places = zip(*[(r.id, r.p) for r in got])
        assert abs(np.corrcoef(ids, places)[0, 1]) < 0.1
        # Neighbours do not stay neighbours.
        assert np.mean(np.abs(np.diff([p for _, p in sorted(zip(ids, places))])) < n / 100) < 0.1


def test_permutation_of_very_many_rows_can_be_undone(spark):
    n = 10**15 + 37
    a, b = permute.grid_sides(n)
    assert 0 <= a * b - n < 10**5
    ids = spark.range(5000).select((F.col("id") * 199999999999 + 11).alias("id")).unionByName(spark.range(n - 3, n))
    order = ids.withColumn("p", permute.permuted(F.col("id"), n, 1))
    got = order.withColumn("back", permute.index_at(F.col("p"), n, 1)).collect()
    assert all(0 <= r.p < n and r.back == r.id for r in got) and len({r.p for r in got}) == 5003
    with pytest.raises(ValueError, match="at least one"):
        permute.grid_sides(0)


def test_epoch_order_fills_batches_and_is_read_back(spark):
    pairs = spark.createDataFrame([(b, m) for b in range(3) for m in range(11)] + [(3, 0), (0, 11), (None, 1)], "b bigint, m bigint")
    got = fusion.epoch_order(pairs, 3, 11, 8, 7, 2).collect()
    outside = [r for r in got if r.batch is None]
    assert {(r.b, r.m) for r in outside} == {(3, 0), (0, 11), (None, 1)}
    assert {(r.batch, r.place) for r in got if r.batch is not None} == {(i // 8, i % 8) for i in range(33)}
    asked = spark.createDataFrame([(r.batch, r.place) for r in got if r.batch in (1, 4)] + [(4, 1), (0, 8)], "batch bigint, place bigint")
    want = {(r.batch, r.place, r.b, r.m) for r in got if r.batch in (1, 4)} | {(4, 1, None, None), (0, 8, None, None)}
    assert {(r.batch, r.place, r.b, r.m) for r in fusion.batch_pairs(asked, 3, 11, 8, 7, 2).collect()} == want
    assert fusion.epoch_order(pairs, 3, 11, 8, 7, 2)._jdf.queryExecution().toString().count("Exchange") == 0
