from collections import Counter

import numpy as np
import pytest

from chromaloom.llm import queries, sharding
from tests.llm.helpers import SF_DIR, needs_tables


def test_matrix_keeps_both_margins():
    rows = [50, 0, 7, 1000, 3]
    matrix = sharding.communication_matrix(rows, 7, 1)
    assert matrix.sum(1).tolist() == rows
    assert matrix.sum(0).tolist() == [152, 152, 152, 151, 151, 151, 151]
    assert (matrix >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([sharding.communication_matrix([6, 6], 2, seed)[0, 0] for seed in range(3000)])
    # 6 of 12 drawn, 6 good ones: C(6,k) C(6,6-k) / C(12,6).
    law = np.array([1, 36, 225, 400, 225, 36, 1]) / 924
    share = np.bincount(draws, minlength=7) / len(draws)
    assert np.abs(share - law).max() < 0.03


def test_large_populations_use_the_inverted_mass_function():
    rng = np.random.default_rng(0)
    good, bad, drawn = 2 * 10**9, 6 * 10**9, 40_000
    values = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(400)])
    assert abs(values.mean() - 10_000) < 5 * np.sqrt(7500 / 400)
    assert 0.7 < values.std() / np.sqrt(7500) < 1.3


@pytest.mark.parametrize("count,order_rows", [(0, 200_000), (3, 200_000), (5000, 20)])
def test_exact_sizes_gapless_slots_and_nothing_lost(spark, monkeypatch, count, order_rows):
    monkeypatch.setattr(sharding, "ORDER_ROWS", order_rows)
    rows = spark.range(count).selectExpr("IF(id % 10 = 0, NULL, id) AS doc_id", "'x' AS shard", "'same' AS text").repartition(5)
    got = sharding.shuffle_to_shards(rows, 40).toPandas()
    assert len(got) == count and list(got.columns) == ["doc_id", "text", "shard", "slot"]
    sizes = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert Counter(got["doc_id"].dropna()) == Counter(float(k) for k in range(count) if k % 10)


def test_neighbours_are_spread(spark):
    got = sharding.shuffle_to_shards(spark.range(4000).withColumnRenamed("id", "doc_id"), 40).toPandas().sort_values("doc_id")
    counts = got.groupby([got["doc_id"] // 400, "shard"]).size()
    assert counts.max() < 30  # ten a cell on average
    assert abs(np.corrcoef(got["doc_id"], got["slot"])[0, 1]) < 0.06


@needs_tables
def test_query(spark):
    got = queries.op5_shard(spark, SF_DIR).toPandas()
    again = queries.op5_shard(spark, SF_DIR).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
