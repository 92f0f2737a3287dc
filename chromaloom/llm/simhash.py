"""SimHash fingerprints and near-duplicate groups found through deletion variants of two segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.components import connected_components
from chromaloom.operators.skew import join_unique
from chromaloom.session import materialise

SEED = 42
SHINGLE = 3
# Fingerprints that share a half with more others than this are linked through whole-fingerprint variants.
BUCKET_ROWS = 256
# Shingle hashes unpacked to bits at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of a text's lower-cased (A-Z) word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, starts, ends, at = b" ".join(words), [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    hashed = xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1 :] or ends[-1:]
    values = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), BLOCK):
        rows = values[k : k + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        values = pa.array([fingerprint(text.as_py()) for text in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; null and wordless texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """66 keys per fingerprint: each 32-bit half whole, and with one bit left out.

    ``side`` is the bit left out (null for a whole half): two halves that differ in exactly that bit meet
    under the same key from different sides, and under no other key of that half.
    """
    slot = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("slot")
    half = "(shiftrightunsigned(fp, CASE WHEN slot < 33 THEN 0 ELSE 32 END) & 4294967295)"
    bit = "shiftleft(1L, slot % 33)"
    return (
        fps.select("fp", "hot", slot)
        .selectExpr("fp", "hot", "slot", f"{half} AS half")
        .selectExpr(
            "fp",
            "hot",
            f"CASE WHEN slot % 33 < 32 THEN CASE WHEN half & {bit} <> 0 THEN 1 ELSE 0 END END AS side",
            f"shiftleft(CAST(slot AS BIGINT), 32) | CASE WHEN slot % 33 < 32 THEN half & ~{bit} ELSE half END AS key",
        )
    )


def _whole_variants(fps: DataFrame) -> DataFrame:
    """The fingerprint with two bits left out, for all 2016 choices; a key has four fingerprints at most."""
    pairs = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> array(i, j))))"
    mask = "(shiftleft(1L, ij[0]) | shiftleft(1L, ij[1]))"
    return fps.selectExpr("fp", f"explode({pairs}) AS ij").selectExpr(
        "fp", "ij[0] * 64 + ij[1] AS slot", f"fp & ~{mask} AS key"
    )


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column fp, unique, written) that differ in 1 or 2 bits.

    Of two bits spread over two halves, one half gets at most one: the halves are indexed whole and with
    one bit left out, joined on equality and verified. Where more than ``bucket_rows`` fingerprints share
    a half, pairs among such fingerprints are found through the fingerprint with two bits left out
    instead, whose groups hold four at most, so no group is paired with itself in full.
    """
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(32))).alias("at")).selectExpr(
        "at", "shiftrightunsigned(fp, at) & 4294967295 AS half"
    )
    crowded = materialise(
        halves.groupBy("at", "half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows), "crowded"
    )
    any_hot = not crowded.isEmpty()
    if any_hot:
        marked = fps
        for at in (0, 32):
            own = crowded.where(F.col("at") == at).select(F.col("half").alias(f"half{at}"), F.lit(True).alias(f"hot{at}"))
            marked = marked.withColumn(f"half{at}", F.expr(f"shiftrightunsigned(fp, {at}) & 4294967295"))
            marked = marked.join(own, f"half{at}", "left")
        hot = F.coalesce("hot0", F.lit(False)) | F.coalesce("hot32", F.lit(False))
        marked = materialise(marked.select("fp", hot.alias("hot")), "marked")
    else:
        marked = fps.select("fp", F.lit(False).alias("hot"))
    keys = _variants(marked)
    left = keys.where("side IS NULL OR side = 0").select("key", "hot", F.col("side"), F.col("fp").alias("a"))
    right = keys.where("side IS NULL OR side = 1").select("key", F.col("hot").alias("hot_b"), F.col("fp").alias("b"))

    def verified(one: DataFrame, other: DataFrame) -> DataFrame:
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
        # Sized by the fingerprints before they were laid out in variants, a side would be broadcast that holds 33 rows for each.
        found = one.hint("merge").join(other, "key").where(near & (F.col("side").isNotNull() | (F.col("a") < F.col("b"))))
        return found.select("a", "b")

    if not any_hot:
        return verified(left, right)
    # A whole half is ordered a < b, so both orders of a hot and a cold fingerprint have to be looked up.
    cold = verified(left.where("NOT hot"), right).unionByName(verified(left.where("hot"), right.where("NOT hot_b")))
    spread = _whole_variants(marked.where("hot"))
    other = spread.select("slot", "key", F.col("fp").alias("b"))
    return cold.unionByName(
        spread.hint("merge").join(other, ["slot", "key"]).where("fp < b").select(F.col("fp").alias("a"), "b")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(``id_col``, fingerprint, component_id) of every row.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest id reachable over
    links. Work is done on distinct fingerprints, so copies cost nothing beyond their own row. Null and
    wordless texts have fingerprint 0 and link like any other. Rows with a null id belong to a component
    but cannot name it (null if it has no other id); repeated rows are each returned. An empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialise(own.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    linked = connected_components(links(fps.select("fp"), bucket_rows))
    members = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    members = materialise(members.select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "members")
    named = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = members.join(named, "root").select("fp", "component_id")
    return join_unique(own, classes, ["fp"]).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each near-duplicate group: that of the smallest id, of equal ids the first one written.

    Rows are decided on one by one: rows of one id but different texts stay or go on their own, repeated rows
    count as copies, and rows without an id come after all others of their group. The rows are written with a
    number first, so that a rerun decides alike.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    own = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    prints = materialise(
        own.select(F.col(number).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
            _row_fingerprints, "_row long, _id long, fp long"
        ),
        "row-fingerprints",
    )
    # The first row of each fingerprint by (id, nulls last, number), then the first of each component.
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    firsts = materialise(prints.groupBy("fp").agg(F.min(place).alias("first")), "first-rows")
    linked = connected_components(links(firsts.select("fp")))
    members = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    kept = members.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(number))
    return own.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _row_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = pa.array([fingerprint(text.as_py()) for text in batch.column(2).cast(pa.binary())], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["_row", "_id", "fp"])
