"""Health of nodes from their latest flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags a node reports.
FLAGS = [
    "restoring",
    "alive",
    "directories",
    "gossip",
    "yml_written",
    "healthy_override",
    "thrift",
    "native",
]


def health_rule() -> Column:
    """A restoring node is healthy; any other needs all of its parts."""
    parts = ["alive", "directories", "gossip", "yml_written", "healthy_override"]
    all_parts = F.col(parts[0])
    for name in parts[1:]:
        all_parts = all_parts & F.col(name)
    return F.col("restoring") | (all_parts & (F.col("thrift") | F.col("native")))


def latest_flags(flags: DataFrame) -> DataFrame:
    """One row per node with the last value of each flag; a flag never reported is false."""

    def latest(name: str) -> Column:
        mine = F.col("flag") == name
        value = F.max_by("value", F.when(mine, F.struct("ts_ms", "seq")))
        return F.coalesce(value, F.lit(name == "healthy_override")).alias(name)

    return flags.groupBy("node").agg(*[latest(name) for name in FLAGS])


def health_status(flags: DataFrame) -> DataFrame:
    return latest_flags(flags).withColumn("healthy", health_rule())
