"""The training-data pipeline: five stages over ``documents``, each written and read again.

Language ID rejects, near duplicates and contaminated documents go; the mix leaves out what a
source has beyond its target weight; sharding adds size, checksum, shard and slot. There is
no SQL for the whole: compression, schedules and the heap are not SQL. Tests compare each
stage with a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.llm import decontamination, langid, mixing, near_dedup, shards
from snapops.llm.common import saved


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is among the verdicts'; rows without an id stay."""
    return docs.join(verdicts.select(F.col("doc_id").alias("__gone")).distinct(), F.col("doc_id") == F.col("__gone"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear from their text. Labelled documents of all ids teach.

    A rejected row's id goes; rows that share an id share its fate.
    """
    return _without(docs, langid.identified(docs, langid.dictionaries(docs)).where("rejected"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return _without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that repeats a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.leaks(docs, benchmark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: sources in natural shares, none above a quarter of the whole."""
    return mixing.mixed_sources(docs).where("in_mix").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with each document's size, checksum, shard and slot."""
    return shards.sharded(docs, 16)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("mix", mix),
    ("shards", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each stage's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
