"""Local files no snapshot knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.constants import COMPACTION_GRACE_DAYS, DAY_MS, READ_GRACE_DAYS
from snapops.operators.filters import orphan_candidates

TABLE = ["cluster", "token", "keyspace", "column_family"]


def orphan_files(
    files: DataFrame, snapshot: DataFrame, snapshot_ms, grace_days: int = COMPACTION_GRACE_DAYS
) -> DataFrame:
    """Candidates whose name is not among the snapshot files of their table."""
    names = snapshot.select(*TABLE, "file_name")
    found = orphan_candidates(files, snapshot_ms, grace_days)
    return found.join(names, [*TABLE, "file_name"], "left_anti")


def orphan_lifecycle(
    orphans: DataFrame,
    markers: DataFrame,
    as_of_ms: int,
    grace_days: int = READ_GRACE_DAYS,
    move_enabled: bool = False,
) -> DataFrame:
    """Next step of every orphan and every earlier mark, with the marks that remain.

    ``markers`` holds ``marked_ms`` per file. LINK starts a mark, WAIT keeps it, MOVE is due
    after the grace period and carried out only when enabled, UNLINK drops the mark of a file
    that is no orphan any more.
    """
    keys = [*TABLE, "file_name"]
    now = orphans.select(*keys).distinct().withColumn("orphan", F.lit(True))
    before = markers.groupBy(*keys).agg(F.min("marked_ms").alias("marked_ms"))
    due = F.lit(as_of_ms) > F.col("marked_ms") + grace_days * DAY_MS
    action = (
        F.when(F.col("orphan").isNull(), "UNLINK")
        .when(F.col("marked_ms").isNull(), "LINK")
        .when(due, "MOVE")
        .otherwise("WAIT")
    )
    moved = F.col("action").isin("MOVE") & F.lit(move_enabled)
    keeps_mark = F.col("action").isin("LINK", "WAIT") | ((F.col("action") == "MOVE") & ~moved)
    return (
        now.join(before, keys, "full_outer")
        .withColumn("action", action)
        .withColumns(
            {
                "moved": moved,
                "next_marked_ms": F.when(keeps_mark, F.coalesce("marked_ms", F.lit(as_of_ms))),
            }
        )
        .select(*keys, "action", "moved", "marked_ms", "next_marked_ms")
    )
