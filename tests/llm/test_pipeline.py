import corpus_pipeline
import pytest

import __spark_entry__ as entry_points
from chromaloom.llm import queries
from tests.llm.helpers import SF_DIR, needs_tables


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, each made from its predecessor's file."""
    out, docs = [spark.read.parquet(f"{SF_DIR}/documents.parquet")], None
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


@needs_tables
def test_every_stage_but_the_last_returns_documents(stages):
    for frame in stages[1:-1]:
        assert frame.columns == corpus_pipeline.COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "mixing", "sharding"]


@needs_tables
def test_language_stage_drops_only_texts_in_no_language(stages):
    before, after = stages[0].toPandas(), stages[1].toPandas()
    gone = before[~before["doc_id"].isin(after["doc_id"])]
    assert all(not any(map(str.isalpha, t or "")) for t in gone["text"])


@needs_tables
def test_one_near_duplicate_of_each_group_stays(spark, stages):
    from chromaloom.llm import simhash
    from tests.llm.test_simhash import components

    before = stages[1].toPandas()
    fps = [simhash.fingerprint(t.encode()) for t in before["text"]]
    groups = {}
    for doc, group in zip(before["doc_id"], components(fps)):
        groups.setdefault(group, []).append(doc)
    assert sorted(stages[2].toPandas()["doc_id"]) == sorted(min(g) for g in groups.values())


@needs_tables
def test_no_whole_item_is_left_and_no_clean_text_gone(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = stages[2].toPandas(), stages[3].toPandas()
    assert not any(item in text for item in items for text in after["text"])
    gone = before[~before["doc_id"].isin(after["doc_id"])]
    assert all(any(item in text for item in items) for text in gone["text"])


@needs_tables
def test_mix_repeats_whole_documents(stages):
    before, after = stages[3].toPandas(), stages[4].toPandas()
    copies = after.groupby("doc_id").size()
    assert copies.max() <= 2 and set(after["doc_id"]) <= set(before["doc_id"])
    words = lambda frame: frame["text"].str.split().str.len().sum()
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.1)


@needs_tables
def test_shards_hold_all_rows_of_the_mix(spark, stages):
    placed = stages[5].toPandas()
    assert sorted(placed["doc_id"]) == sorted(stages[4].toPandas()["doc_id"])
    sizes = placed.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1


def test_all_queries_are_registered():
    names = set(entry_points.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.SQL) <= set(queries.QUERIES)
