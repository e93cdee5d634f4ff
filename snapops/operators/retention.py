"""What a backup may lose: objects past retention and rules on the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.constants import COMPACTION_GRACE_DAYS, DAY_MS, FEATURE_START_MS, HOUR_MS
from snapops.operators.manifests import Entries, entries_of
from snapops.session import kept

NODE = ["cluster", "token"]


def retention_plan(
    catalog: DataFrame,
    entries: Entries,
    judged: DataFrame,
    as_of_ms: int,
    retention_days: int,
    grace_days: int = COMPACTION_GRACE_DAYS,
    feature_start_ms: int = FEATURE_START_MS,
) -> DataFrame:
    """Objects to delete: ``(cluster, token, file_type, remote_path, last_modified_ms)``.

    Per node the oldest manifest inside the retention period is the keep set. A node without
    one, or whose keep set is empty, loses nothing. Otherwise manifests older than the period
    by an hour go, and table files older than the period and grace that the keep set lacks.
    ``judged(manifest_path, available)``, as ``judge_manifests`` gives it, says which manifests
    are whole: a node whose keep manifest lost a part, could not be read or is not judged at
    all loses nothing either.

    Time filters apply before any join; the keep set and the candidates meet once, on the
    object path. The keep manifests and the nodes that have one, a row per node, are written
    down, so that large tables meet them by their measured size.
    """
    period_ms = as_of_ms - retention_days * DAY_MS
    cutoff_ms = period_ms - grace_days * DAY_MS
    modified = F.col("last_modified_ms")
    manifests = catalog.filter(F.col("file_type") == "META_V2")
    oldest = (
        manifests.filter(modified.between(period_ms, as_of_ms))
        .groupBy(*NODE)
        .agg(F.min_by("remote_path", F.struct("last_modified_ms", "remote_path")).alias("manifest_path"))
    )
    whole = judged.groupBy("manifest_path").agg(F.min("available").alias("available")).filter("available")
    oldest = kept(oldest.join(whole, "manifest_path", "left_semi"), "keep-manifests")
    keep = entries_of(entries, oldest).join(oldest, [*NODE, "manifest_path"], "left_semi").select(*NODE, "backup_path")
    guard = kept(keep.select(*NODE).distinct(), "keep-nodes")

    def report(rows: DataFrame) -> DataFrame:
        return rows.select(*NODE, "file_type", "remote_path", "last_modified_ms")

    old_manifests = report(
        manifests.filter(modified.between(feature_start_ms, period_ms - HOUR_MS))
    )
    candidates = report(catalog.filter((F.col("file_type") == "SST_V2") & (modified <= cutoff_ms)))
    kept_paths = keep.select(F.col("backup_path").alias("remote_path"))
    old_files = candidates.join(kept_paths, "remote_path", "left_anti").select(*candidates.columns)
    return old_manifests.unionByName(old_files).join(guard, NODE, "left_semi")


def lifecycle_rule_plan(prefixes: DataFrame, rules: DataFrame) -> DataFrame:
    """Change each wanted prefix needs on the store's expiry rules.

    ``prefixes(prefix, retention_days)``, ``rules(rule_no, prefix, expiration_days, status)``.
    Prefixes match without case; the first rule of a prefix is the one that counts.
    """
    first = (
        rules.groupBy(F.lower("prefix").alias("folded"))
        .agg(F.min_by(F.struct("expiration_days", "status"), "rule_no").alias("rule"))
        .select("folded", "rule")
    )
    wanted = F.col("retention_days") > 0
    has_rule = F.col("rule").isNotNull()
    same = (F.col("rule.expiration_days") == F.col("retention_days")) & (
        F.lower("rule.status") == "enabled"
    )
    action = (
        F.when(~wanted & has_rule, "REMOVE")
        .when(~wanted, "NONE")
        .when(~has_rule, "ADD")
        .when(same, "NONE")
        .otherwise("UPDATE")
    )
    joined = prefixes.withColumn("folded", F.lower("prefix")).join(first, "folded", "left")
    return joined.select("prefix", "retention_days", action.alias("action"))
