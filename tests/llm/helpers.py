"""What several test files need: SQL over the small tables, and the plain rules of the shared contracts."""

import os
import zlib

import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def sql(statement):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection.execute(statement)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def documents(spark, pairs, **extra):
    """doc_id and text of the pairs, with constant further columns."""
    names = ["doc_id", "text", *extra]
    schema = "doc_id long, text string" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([(*p, *extra.values()) for p in pairs], schema).select(*names)
