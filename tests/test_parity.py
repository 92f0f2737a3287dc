"""Queries against their SQL on the small tables.

A selection by default; CHROMALOOM_PARITY=all runs every query.
"""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from chromaloom.plans import catalog

SF_DIR = os.environ.get("CHROMALOOM_PARITY_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = [
    "a1_coverage", "a1_balanced_margins", "a2_read_bedpe10", "a5_read_fasta", "a6_read_expression_files", "a8_read_pairs", "b2_filter_chroms", "b3_contact_mode", "b9_region_index", "d1_matrix_dims",
    "d3_symmetrise", "d4_window_stats", "d9_label_matrix", "f17_epoch_order", "d14_spearman_by_biosample", "d14_spearman_flat", "d15_mean_pool",
    "f5_contact_rgb", "f8_reverse_complement", "f13_to_float16", "g4_pad_columns", "g6_fuse", "j1_stored_windows", "j1_blocks_read", "k1_tiled_contacts", "j2_assemble", "j8_fetch_sequences",
    "j11_biosample_split_join", "j13_impute_from_nearest", "k10_resume_windows", "p2_perturb_expected", "p4_score_pairs", "u1_embed_sequences", "u3_predict_joint", "u7_decoder_outputs", "u7_decoder_scores", "u7_decoder_fused", "w4_biosample_major_order",
]
ALL = entry_points.queries()
NAMES = list(catalog.QUERIES) if os.environ.get("CHROMALOOM_PARITY") == "all" else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sql, name):
    got = ALL[name](spark, SF_DIR).toPandas()
    want = sql.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows(got) == rows(want)


def test_every_surveyed_operator_is_registered():
    sizes = {"a": 14, "k": 10, "b": 16, "j": 13, "d": 16, "w": 5, "f": 17, "g": 6, "p": 4, "u": 7}
    wanted = {f"{letter}{i}" for letter, n in sizes.items() for i in range(1, n + 1)}
    assert {re.match(r"[a-z]\d+", name).group() for name in catalog.QUERIES} == wanted
    assert set(catalog.SQL) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(ALL) and set(entry_points.oracle_sql()) <= set(ALL)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 189
