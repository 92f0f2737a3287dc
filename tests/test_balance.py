import numpy as np
import pytest

from chromaloom.operators import balance

CELLS = "accession string, chrom string, row int, col int, value double"


def matrix(seed, size, empty=()):
    rng = np.random.default_rng(seed)
    half = np.triu(rng.poisson(1.0, (size, size)) * rng.random((size, size)))
    full = half + half.T + np.diag(rng.random(size) * 5 + 5)
    for i in empty:
        full[i] = full[:, i] = 0
    return full


def cell_rows(accession, full):
    return [(accession, "chr1", int(r), int(c), float(full[r, c])) for r, c in zip(*np.nonzero(full))]


def dense(df, accession, size):
    full = np.zeros((size, size))
    for r in df.where(f"accession = '{accession}'").collect():
        full[r.row, r.col] = r.value
    return full


@pytest.fixture(scope="module")
def two(spark):
    mats = {"a": matrix(1, 30, (4, 17)), "b": matrix(2, 12)}
    return mats, spark.createDataFrame([row for acc, m in mats.items() for row in cell_rows(acc, m)], CELLS)


@pytest.mark.parametrize("norm", ["VC", "VC_SQRT"])
def test_coverage_divides_by_the_margins_and_keeps_the_total(two, norm):
    mats, cells = two
    got = balance.normalise(cells, norm)
    for name, m in mats.items():
        v = m.sum(axis=1) ** (0.5 if norm == "VC_SQRT" else 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.where(np.outer(v, v) > 0, m / np.outer(v, v), 0)
        np.testing.assert_allclose(dense(got, name, len(m)), want * m.sum() / want.sum(), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("norm", ["KR", "SCALE"])
def test_balanced_margins_are_equal_and_the_form_is_kept(two, norm):
    mats, cells = two
    got = balance.normalise(cells, norm)
    for name, m in mats.items():
        full = dense(got, name, len(m))
        filled = m.sum(axis=1) > 0
        margin = full.sum(axis=1)
        np.testing.assert_allclose(margin[filled], m.sum() / filled.sum(), rtol=3e-4)
        assert (margin[~filled] == 0).all() and np.allclose(full, full.T)
        # Divided by an outer product of factors, as the ratio of any cell to the raw one says.
        v = np.sqrt(np.diag(m)[filled] / np.diag(full)[filled])
        np.testing.assert_allclose(full[np.ix_(filled, filled)] * np.outer(v, v), m[np.ix_(filled, filled)], rtol=1e-9)


def test_matrices_finish_on_their_own_and_report_it(spark, two):
    mats, cells = two
    flat = spark.createDataFrame(cell_rows("even", np.ones((3, 3))), CELLS)
    by = balance.balanced_factors(cells.unionByName(flat)).groupBy("accession").agg({"rounds": "max", "residual": "max", "bin": "count"}).collect()
    rounds = {r.accession: r["max(rounds)"] for r in by}
    assert rounds["even"] == 0 and rounds["a"] > 0 and all(r["max(residual)"] <= 1e-4 for r in by)
    assert {r.accession: r["count(bin)"] for r in by} == {"a": 28, "b": 12, "even": 3}


def test_a_matrix_that_cannot_be_balanced_is_refused(spark):
    # Three bins that meet only the fourth cannot all have its margin.
    star = np.zeros((4, 4))
    star[3, :3] = star[:3, 3] = 1.0
    with pytest.raises(ValueError, match="off balance after 5 rounds"):
        balance.balanced_factors(spark.createDataFrame(cell_rows("a", star), CELLS), max_rounds=5)
    with pytest.raises(ValueError, match="is none of"):
        balance.normalise(spark.createDataFrame([], CELLS), "ICE")


def test_empty_cells_and_no_normalisation(spark, two):
    none = spark.createDataFrame([], CELLS)
    assert all(balance.normalise(none, norm).collect() == [] for norm in ("NONE", "VC", "KR"))
    assert balance.normalise(two[1], "NONE") is two[1]
