"""A corpus from raw documents to shards: each stage applies one operator to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaloom.llm import latent, mixing, ppm, sharding, simhash
from chromaloom.session import materialise

# The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents are written in."""
    return ppm.in_known_language(docs.select(*COLUMNS), ppm.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours."""
    return simhash.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return latent.without_leaks(docs.select(*COLUMNS), latent.fit(docs, benchmark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are left out, kept, or repeated."""
    return mixing.repeat(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, the order in which shards are to be written."""
    rows = docs.select("doc_id", "source", "lang", sharding.text_size("text").alias("size"))
    return sharding.shuffle_to_shards(rows, SHARDS)


STAGES = [
    ("language", known_language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The models and the seeded permutation cannot be said in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
