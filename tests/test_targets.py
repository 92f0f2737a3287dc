import os

import duckdb
import pytest

from chromaloom.plans import catalog_features, features
from chromaloom.plans.ctes import build

SF_DIR, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_every_target_of_a_stored_window_is_asked(spark):
    """Where part keys go beyond the smallest table's, too."""
    connection = duckdb.connect()
    for name in ("lineitem", "part"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    want = build("SELECT k.accession, t.target_idx FROM fx_targets t JOIN keys k ON t.submat_key = k.submat_key")
    want = sorted(connection.execute(want).fetchall())
    got = features.target_pairs(spark, SF_DIR).select("accession", "target_idx").collect()
    assert len(want) > 3 * 543 and sorted(map(tuple, got)) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_every_stored_target_is_edited_right(spark):
    """p2 against its SQL, asked of the stored windows' targets instead of the cut table's."""
    connection = duckdb.connect()
    for name in ("lineitem", "part"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    whole = "(SELECT k.accession, t.* FROM fx_targets t JOIN keys k ON t.submat_key = k.submat_key)"
    text = build("SELECT accession, target_idx, row, col, round(value, 6) + 0.0::DOUBLE AS value FROM pert_cells", asked=whole)
    want = connection.execute(text).fetchall()
    got = catalog_features.perturb_expected(spark, SMALL).select("accession", "target_idx", "row", "col", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pairs_are_not_written_with_their_windows(spark, monkeypatch):
    """A window is written once, not once for every target that asks for it."""
    written = []
    plain = features.materialise
    monkeypatch.setattr(features, "materialise", lambda df, label: written.append(df.columns) or plain(df, label))
    assert features.target_pairs(spark, SMALL).count() > 0
    assert not any("data" in columns and "target_idx" in columns for columns in written)
