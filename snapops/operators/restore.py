"""Files a point-in-time restore needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapops.constants import MAX_COMMIT_LOGS
from snapops.operators.catalog import build_catalog, rejected_rows, restore_target, valid_rows
from snapops.operators.filters import filter_keyspace_table
from snapops.operators.manifests import Entries, entries_of
from snapops.operators.nearest import closest_token
from snapops.operators.verify import latest_valid_manifest
from snapops.ranges import DateRange
from snapops.session import kept

NODE = ["cluster", "token"]
PLAN = [*NODE, "origin", "file_type", "keyspace", "column_family", "remote_path", "target"]


def last_n_commitlogs(catalog: DataFrame, n: int = MAX_COMMIT_LOGS) -> DataFrame:
    """Last ``n`` commit logs of each node in path order.

    The rank filter is applied on each side of the shuffle, so at most ``n`` rows per node
    and input task travel.
    """
    newest = Window.partitionBy(*NODE).orderBy(F.desc("remote_path"))
    logs = catalog.filter(F.col("file_type") == "CL")
    return logs.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n).drop("rank")


def keep_largest_n(values: DataFrame, column: str, n: int, group: list[str] | None = None) -> DataFrame:
    """The ``n`` largest distinct values, overall or per group."""
    group = group or []
    distinct = values.select(*group, column).distinct()
    if not group:
        return distinct.orderBy(F.desc(column)).limit(n)
    largest = Window.partitionBy(*group).orderBy(F.desc(column))
    return distinct.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= n).drop("rank")


def unrestorable(entries: Entries, verdicts: DataFrame, span: DateRange, v2: bool = True) -> DataFrame:
    """``(remote_path, error)`` of the chosen manifests' paths that no restore can place."""
    chosen = kept(latest_valid_manifest(verdicts, span, closed=v2).select("manifest_path"), "chosen")
    listed = entries_of(entries, chosen)
    return rejected_rows(build_catalog(listed.select(F.col("backup_path").alias("remote_path"), "size", F.lit(None).cast("bigint").alias("modified_ms"))))


def nearest_sources(wanted: DataFrame, backed_up: DataFrame) -> DataFrame:
    """``(cluster, token, source_token)``: the backed-up token nearest to each node's own.

    A node whose token was never backed up, as after a ring was rebuilt with other tokens,
    restores from the nearest one of its cluster; of two at one distance, from the higher. A
    cluster without backups has null sources.
    """
    found = closest_token(wanted.select(*NODE).distinct(), backed_up.select(*NODE).distinct(), ["cluster"])
    return found.select(*NODE, F.col("closest").alias("source_token"))


def plan_from_sources(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """The plan of each node's source as the plan of the node; several nodes may share a source."""
    of_source = plan.withColumnRenamed("token", "source_token")
    return kept(sources, "sources").join(of_source, ["cluster", "source_token"]).select(*PLAN, "source_token")


def restore_plan(
    catalog: DataFrame,
    entries: Entries,
    verdicts: DataFrame,
    span: DateRange,
    *,
    include: str | None = None,
    exclude: str | None = None,
    incrementals: bool = True,
    commit_logs: int = 0,
    v2: bool = True,
    data_dir: str = "/data",
    commit_log_dir: str = "/commitlog",
    racks: DataFrame | None = None,
    backup_racks: list[str] | None = None,
) -> DataFrame:
    """Snapshot files, later incrementals and the last commit logs of every node.

    The snapshot is the newest valid manifest of the range. A file in both the snapshot and
    the incrementals is listed twice, with its origin. Paths that do not parse are no rows of
    the plan; ``unrestorable`` lists them. ``racks(cluster, token, rack)`` and
    ``backup_racks`` keep only nodes of those racks; an empty list keeps all. The choice, a
    row per node, is written down: the manifests are verified once, and the catalog meets the
    few nodes by their measured size.
    """
    chosen = latest_valid_manifest(verdicts, span, closed=v2)
    if backup_racks:
        inside = racks.filter(F.col("rack").isin(backup_racks)).select(*NODE).distinct()
        chosen = chosen.join(inside, NODE, "left_semi")
    chosen = kept(chosen, "chosen")

    listed = entries_of(entries, chosen).select(
        F.col("backup_path").alias("remote_path"),
        "size",
        F.lit(None).cast("bigint").alias("modified_ms"),
    )
    plan = valid_rows(build_catalog(listed)).withColumn("origin", F.lit("snapshot"))
    starts = chosen.select(*NODE, "snapshot_ms")
    if incrementals:
        moment = F.col("last_modified_ms") if v2 else F.col("time_ms")
        file_type = "SST_V2" if v2 else "SST"
        later = (
            catalog.filter((F.col("file_type") == file_type) & (moment <= span.end_ms))
            .join(starts, NODE)
            .filter(moment >= F.col("snapshot_ms"))
        )
        if not v2:
            later = later.filter((moment < span.end_ms) | (moment == F.col("snapshot_ms")))
        plan = plan.unionByName(
            later.drop("snapshot_ms").withColumn("origin", F.lit("incremental"))
        )
    if commit_logs:
        logs = catalog.filter((F.col("file_type") == "CL") & (F.col("time_ms") <= span.end_ms))
        logs = logs.join(starts, NODE).filter(
            (F.col("time_ms") == F.col("snapshot_ms"))
            | ((F.col("time_ms") > F.col("snapshot_ms")) & (F.col("time_ms") < span.end_ms))
        )
        plan = plan.unionByName(
            last_n_commitlogs(logs.drop("snapshot_ms"), commit_logs).withColumn(
                "origin", F.lit("commitlog")
            )
        )
    wanted = filter_keyspace_table(plan, include, exclude)
    return wanted.withColumn("target", restore_target(data_dir, commit_log_dir)).select(*PLAN)
