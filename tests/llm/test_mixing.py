import pytest

from chromaloom.llm import mixing, queries
from tests.llm.helpers import SF_DIR, needs_tables, rows, sql


def filled(sizes, weights, share, epochs):
    """Targets by rounds of clamping and sharing anew."""
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = {k: w for k, w in weights.items() if k not in fixed}
        left = budget - sum(fixed.values())
        aims = {k: left * w / sum(free.values()) for k, w in free.items()}
        over = {k: epochs * sizes[k] for k in aims if aims[k] >= epochs * sizes[k]}
        if not over:
            return {**aims, **fixed}
        fixed.update(over)
        if len(fixed) == len(sizes):
            return fixed


@pytest.mark.parametrize("share,epochs", [(1.5, 2.0), (0.4, 1.0), (3.0, 2.0), (1.0, 1.5)])
def test_targets_are_the_fixed_point_of_rounds(spark, share, epochs):
    sizes = {"a": 1000, "b": 10, "c": 0, "d": 300, None: 77, "é": 5000}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    weighted = frame.join(mixing.cyclic_weights(frame.select("source")).withColumnRenamed("source", "of"), frame.source.eqNullSafe(mixing.F.col("of")))
    got = {r["source"]: r["target"] for r in mixing.targets(weighted.drop("of"), share, epochs).collect()}
    weights = dict(zip(["a", "b", "c", "d", "é", None], [5.0, 2.0, 1.0, 5.0, 2.0, 1.0]))
    want = filled(sizes, weights, share, epochs)
    assert got == pytest.approx(want)


@needs_tables
def test_query_equals_its_sql(spark):
    got = queries.op4_mix_sources(spark, SF_DIR).toPandas()
    want = sql(queries.SQL["op4_mix_sources"]).df()
    assert rows(got) == rows(want)
    sums = got.groupby(["target"])["taken"].sum()
    by_source = sql("SELECT doc_id, source FROM documents").df().merge(got, on="doc_id").groupby("source")
    assert ((by_source["taken"].sum() - by_source["target"].first()).abs() <= by_source["size"].max() / 2 + 1e-6).all()
    assert (got["taken"] <= 2 * got["size"]).all() and len(sums)


def test_nulls_ties_and_clashing_names(spark):
    data = [(1, "a b c", None, "x"), (1, "a b c", None, "x"), (None, None, "s", "x"), (2, "", "s", "x"), (None, "w " * 50, None, None), (3, "one", "s", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    out = got.collect()
    assert len(out) == 6
    assert {r["source_size"] for r in out if r["source"] is None} == {56}
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2 for r in out)
    twins = [r["copies"] for r in out if r["doc_id"] == 1]
    assert twins[0] == twins[1]
    assert rows(mixing.mix(docs).toPandas()) == rows(got.toPandas())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0


def test_repeat_gives_whole_copies(spark):
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, copies long")
    assert sorted(r[0] for r in mixing.repeat(docs, ["doc_id"]).collect()) == [2, 3, 3]
