"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and found below this.
BROADCAST_ROWS = 2_000_000


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Rows here may carry whole windows or sequences, so Arrow batches stay short.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Temporary folders of local sessions that name no shared one, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; local sessions without one get a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="chromaloom-")
    return _LOCAL_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), "chromaloom", f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read the copy.

    Survives lost executors, is computed once however often it is used, and lets
    the optimiser see the true size of the table.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made inside go when their query ends, not when the driver happens to collect garbage.

    For rounds whose results are written or collected. A query made inside and run a second time makes its files anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bucketed(df: DataFrame, label: str, buckets: int, key: str) -> DataFrame:
    """Write once to the shared folder, one file per bucket of ``key``, and read the copy as a bucketed table.

    Joins and groups on ``key`` with other tables of so many buckets then need no exchange. The table is known to
    this session's catalog under a name of its own.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast a written table if its counted rows allow it, otherwise leave the join to a shuffle.

    Meant for narrow rows (names and a few numbers), so the row count bounds the size; the count of a
    written table only reads file footers.
    """
    if df.count() <= max_rows:
        return F.broadcast(df), True
    return df, False
