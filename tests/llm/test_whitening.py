import numpy as np
import pytest
from pyspark.sql import Row

from chromaloom.llm import queries, whitening
from tests.llm.helpers import SF_DIR, needs_tables

SCHEMA = "vec_id long, embedding array<float>, component string, w string, _index string"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(vectors, components=8):
    """Deviations, whitened rows (signs as they come) and shares, in one place."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviations = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return deviations, centred @ axes / np.sqrt(values), values / np.trace(covariance)


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in pairs], SCHEMA)


def compare(got, ids, vectors, components=8):
    deviations, white, shares = plain(vectors, components)
    assert len(got) == len(ids) * components
    table = {(r.vec_id, r.component): r for r in got}
    for column in range(components):
        mine = np.array([table[i, column + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, column])
        assert np.allclose(mine, sign * white[:, column], rtol=1e-7, atol=1e-9)
    for i, deviation in zip(ids, deviations):
        for column in range(components):
            row = table[i, column + 1]
            assert (row.n, row.deviation) == (len(ids), deviation)
            assert row.explained == pytest.approx(shares[column], rel=1e-9)
            assert 0 <= row.identity_error < 1e-9


@pytest.mark.parametrize("block_rows", [7, 50, 4096])
def test_equals_plain_whitening_whatever_the_blocks(spark, block_rows):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = frame(spark, list(enumerate(vectors.tolist()))).repartition(5)
    got = whitening.whiten(rows, block_rows=block_rows)
    assert got.columns == COLUMNS
    compare(got.collect(), range(150), vectors)


def test_unusable_vectors_are_dropped_and_repeats_kept(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 2.0], [1e30, 1.0, 1.0], [1.0, 2.0], [1.0] * 4]
    pairs = list(enumerate(good)) + [(1000 + k, v) for k, v in enumerate(bad)]
    compare(whitening.whiten(frame(spark, pairs)).collect(), range(40), good, components=3)
    repeated = whitening.whiten(frame(spark, [(5, v) for v in good] + [(None, v) for v in good])).collect()
    assert len(repeated) == 80 * 3 and {r.n for r in repeated} == {80}
    assert sum(r.vec_id is None for r in repeated) == 40 * 3


def test_components_that_do_not_vary_are_null(spark):
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [
        (1, 1, 0, None, 0.0, None),
        (2, 1, 0, None, 0.0, None),
    ]
    flat = whitening.whiten(frame(spark, [(k, [float(k), 3.0, 5.0]) for k in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in flat)
    assert len(flat) == 27


def test_deviations_beyond_64_bits_are_null(spark):
    rows = whitening.whiten(frame(spark, [(1, [1e11]), (2, [-1e11])])).collect()
    assert [r.deviation for r in rows] == [None, None] and sorted(round(r.whitened, 9) for r in rows) == [-1, 1]


def test_empty_tables(spark):
    for pairs in ([], [(1, None), (2, [])]):
        got = whitening.whiten(frame(spark, pairs))
        assert got.columns == COLUMNS and got.count() == 0


def test_whole_numbers_round_down(spark):
    got = whitening.whole_numbers(spark.createDataFrame([Row(embedding=[0.5, -0.0001, 0.0])])).first()
    assert got.x == [100_512, 99_999, 100_000]


@needs_tables
def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    got = queries.op11_whiten(spark, SF_DIR)
    assert got.columns == COLUMNS
    compare(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
