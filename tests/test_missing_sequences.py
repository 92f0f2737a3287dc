"""Queries over intervals of which some lie on contigs without a sequence, against their SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
from chromaloom.operators import sequence
from chromaloom.session import materialise
from tests.test_parity import rows

NAMES = [
    "f9_one_hot", "j6_perturbation_pairs", "j8_fetch_sequences", "j9_seq_by_region", "k5_write_tokens", "k7_write_sequence_predictions", "k9_write_attributions",
    "p4_score_pairs", "u1_embed_sequences", "u3_predict_joint", "u4_predict_sequence", "u6_input_x_gradient",
]
ALL = entry_points.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Null and empty texts and a gap in the ids."""
    path, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ACGTacgtN x"), n)) for n in (1, 40, 100, 128, 300, 4200, 9000)]
    ids = [0, 1, 3, 4, 5, 7, 30]
    docs = [*zip(ids, texts), (2, None), (6, ""), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    parts = [(k, f"part {k}", f"Brand#1{k % 5}", k % 50) for k in range(25)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size long").write.parquet(f"{path}/part.parquet")
    items = [(int(a), int(b), int(c), int(d), float(e)) for a, b, c, d, e in zip(*(rng.integers(0, n, 3000) for n in (200, 5, 400, 400, 45)))]
    items = [(a, b + 1, c, d, e + 1) for a, b, c, d, e in items]
    schema = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(items, schema).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_intervals_without_a_sequence_give_no_row(spark, tables, name):
    connection = duckdb.connect()
    for table in ("documents", "part", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    got = ALL[name](spark, str(tables)).toPandas()
    want = connection.execute(entry_points.oracle_sql()[name]).df()
    assert len(want) > 0 and rows(got) == rows(want)


@pytest.mark.parametrize("most", [200_000, 0])
def test_unknown_contigs_are_told(spark, monkeypatch, most):
    """Whether the names are broadcast or shuffled."""
    monkeypatch.setattr(sequence, "BROADCAST_CONTIGS", most)
    bed = spark.createDataFrame([(0, "a", 5), (1, "b", 6), (2, None, 7), (2, "a", 7)], "region_idx long, chrom string, start_bp long")
    lengths = materialise(spark.createDataFrame([("a", 9), ("c", 3)], "chrom string, contig_len long"), "lengths")
    known = sequence.on_contigs(bed, lengths)
    assert sorted(map(tuple, known.collect())) == [(0, "a", 5), (2, "a", 7)]
    assert ("Broadcast" in known._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    assert sorted(map(tuple, sequence.unknown_contigs(bed, lengths).collect())) == [(1, "b"), (2, None)]
