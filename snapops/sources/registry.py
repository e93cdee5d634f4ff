"""Ring registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_registry(registry: DataFrame, app: str) -> DataFrame:
    """All instances of an application in id order."""
    return registry.filter(F.col("app") == app).orderBy("dc", "id")


def registry_row(registry: DataFrame, app: str, dc: str, instance_id: int) -> DataFrame:
    return registry.filter(
        (F.col("app") == app) & (F.col("dc") == dc) & (F.col("id") == instance_id)
    )
