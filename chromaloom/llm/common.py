"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

# A word: any run of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text) % F.lit(modulus)


def word_count(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def arrow_column(function: Callable[[pa.Array], pa.Array], returns: str, text_col: str) -> Column:
    """A column computed from the whole texts, one Arrow batch at a time; other columns stay where they are."""
    return F.arrow_udf(function, returns, ArrowUDFType.SCALAR)(F.col(text_col).cast("string"))


def _opener(packed: Broadcast) -> Callable[[], object]:
    opened = []

    def get() -> object:
        if not opened:
            opened.append(cloudpickle.loads(packed.value))
        return opened[0]

    return get


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a model of bounded size; the returned function gives it in a task.

    It is packed together with the code of its class, so executors need no copy of the package.
    """
    return _opener(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


class _Opened:
    """Reads back as the value itself."""

    def __init__(self, value: object):
        self.packed = cloudpickle.dumps(value)

    def __reduce__(self) -> tuple:
        return cloudpickle.loads, (self.packed,)


def kept(spark: SparkSession, value: object) -> Callable[[], object]:
    """As ``shared``, but opened once by a Python worker and not by each task: what the value remembers stays."""
    packed = spark.sparkContext.broadcast(_Opened(value))
    return lambda: packed.value


@contextmanager
def lent(spark: SparkSession, value: object) -> Iterator[Callable[[], object]]:
    """As ``shared``, for jobs that end inside the block: every copy of the model goes afterwards."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    try:
        yield _opener(packed)
    finally:
        packed.destroy()
