import numpy as np
import pytest

from chromaloom.llm import forest, queries
from tests.llm.helpers import SF_DIR, needs_tables, sql


def nearest(vectors, ids, query, k=10):
    distance = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, distance)) if ids[j] != query]
    return [(int(ids[j]), float(distance[j])) for j in order[:k]]


@needs_tables
def test_recall_and_scores_of_the_query(spark):
    got = queries.op7_nearest_vectors(spark, SF_DIR).toPandas()
    table = sql("SELECT vec_id, embedding FROM embeddings").df()
    vectors, ids = np.array(table["embedding"].tolist(), np.float64), table["vec_id"].to_numpy()
    hits = []
    for query, own in got.groupby("query_id"):
        want = dict(nearest(vectors, ids, query))
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and len(own) == min(10, len(ids) - 1)
        assert own["score"].is_monotonic_increasing
        exact = np.sqrt(((vectors[np.searchsorted(ids, own["vec_id"])] - vectors[ids == query][0]) ** 2).sum(1))
        assert np.allclose(own["score"], exact, rtol=1e-12)
        hits.append(np.mean([v in want for v in own["vec_id"]]))
    assert len(hits) == sum(k % 100 == 0 for k in ids) and np.mean(hits) >= 0.9


@pytest.mark.parametrize("block_rows", [100_000, 40, 7])
def test_blocks_and_pieces_change_nothing(spark, block_rows):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(150, 6)), np.repeat(rng.normal(size=(1, 6)), 60, 0) + rng.normal(size=(60, 6)) * 1e-9])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 20 = 0")
    got = forest.nearest(frame, asked, candidates=0.05, block_rows=block_rows).collect()
    want = forest.nearest(frame, asked, candidates=0.05).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 110


def test_all_candidates_make_it_exact(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(60, 5))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = forest.nearest(frame, frame.where("vec_id < 5"), candidates=1e9).toPandas()
    for query in range(5):
        own = got[got["query_id"] == query].sort_values("rank")
        assert own["vec_id"].tolist() == [v for v, _ in nearest(vectors, np.arange(60), query)]


def test_copies_invalid_vectors_and_nulls(spark):
    rows = [(k, [1.0, 2.0]) for k in range(30)] + [(40, [1.5, 2.0]), (41, None), (42, [0.0, 0.0]), (43, [1.0, None]), (44, [float("nan"), 1.0]), (45, [float("inf"), 1.0]), (46, [1.0]), (None, [1.0, 2.0]), (47, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = forest.nearest(frame, frame.where("vec_id IN (5, 41, 42, 46)")).toPandas().sort_values("rank")
    assert set(got["query_id"]) == {5}
    assert got["vec_id"].tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and (got["score"] == 0).all()


def test_few_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in forest.nearest(frame, frame.where("vec_id = 1")).collect()] == [(1, 1, 2)]
    none = frame.where("false")
    assert forest.nearest(none, none).count() == 0
    assert forest.nearest(frame, none).count() == 0
