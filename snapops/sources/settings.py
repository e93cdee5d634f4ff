"""Configuration rows of the single sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def app_of_group(group: str) -> str:
    """Application of a scaling group: the text before its first dash."""
    return group[: group.index("-")] if group.rfind("-") > 0 else group


def scan_config_region(rows: DataFrame, region: str) -> DataFrame:
    """One value per (app, property): the last row of this region, else the first regionless row.

    Both picks are partial aggregates over the arrival order ``seq``.
    """
    blank = F.coalesce(F.trim("region"), F.lit("")) == ""
    mine = F.col("region") == region
    picked = (
        rows.filter(blank | mine)
        .groupBy("app", "property")
        .agg(
            F.max_by(F.when(~blank, F.struct("value")), F.when(~blank, F.col("seq"))).alias("own"),
            F.min_by(F.when(blank, F.struct("value")), F.when(blank, F.col("seq"))).alias("common"),
        )
    )
    return picked.select("app", "property", F.coalesce("own", "common")["value"].alias("value"))


def scan_properties(rows: DataFrame) -> DataFrame:
    """Entries of a properties source that carry a value."""
    return rows.filter(F.length("value") > 0)
