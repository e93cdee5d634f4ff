"""Counters and size summaries of transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transfer_metrics(events: DataFrame) -> DataFrame:
    """Per node and kind: how many, total, largest and mean size (in whole bytes)."""
    return events.groupBy("node", "kind").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("size").alias("total_size"),
        F.max("size").alias("max_size"),
        F.expr("sum(size) div count(size)").alias("mean_size"),
    )
