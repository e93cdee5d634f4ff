"""Upload candidates, their codec and order, and what is left to upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapops.constants import (
    COMPRESSION_INFO_SUFFIX,
    DATA_FILE_SUFFIX,
    HOUR_MS,
    MANIFEST_V1_NAME,
    MANIFEST_V2_PATTERN,
    MINUTE_MS,
    SLO_HOURS,
)
from snapops.functions.text import before_last, instant_ms
from snapops.operators.catalog import is_data, is_v2, remote_path
from snapops.operators.manifests import sstable_prefix
from snapops.sources.listing import scan_data_dir

NODE = ["cluster", "token"]


def build_upload_table(inventory: DataFrame, data_dir: str, base_dir: str, file_type: str) -> DataFrame:
    """Candidates of one type from the local files, with the object path each one gets.

    A snapshot file is dated by its snapshot folder, any other by its modification. A file
    whose status could not be read counts as modified at the epoch with size 0.
    """
    files = scan_data_dir(inventory, data_dir)
    modified = F.coalesce("modified_ms", F.lit(0)).cast("bigint")
    dated = instant_ms(F.col("snapshot_name")) if file_type == "SNAP" else modified
    table = files.withColumns(
        {
            "file_type": F.lit(file_type),
            "is_data": is_data(F.lit(file_type)),
            "base_dir": F.lit(base_dir),
            # the object path keeps the table folder as it is, id suffix included
            "column_family": F.col("table_dir"),
            "prefix": sstable_prefix(F.col("file_name")),
            "is_incremental": F.coalesce(F.col("folder") == "backups", F.lit(False)),
            "last_modified_ms": modified,
            "size": F.coalesce("size", F.lit(0)).cast("bigint"),
            "time_ms": dated,
            "compression": F.lit("SNAPPY"),
            "encryption": F.lit("PLAINTEXT"),
        }
    )
    return with_remote_path(table)


def build_log_and_manifest_uploads(inventory: DataFrame, data_dir: str, commit_log_dir: str, base_dir: str) -> DataFrame:
    """Candidates that belong to no table: commit logs, and the manifests beside the table folders.

    Files of the commit log folder are ``CL``; of the files that lie directly in the data
    folder ``meta_v2_<time>.json`` is ``META_V2`` and ``meta.json`` ``META``; all others are
    no candidates. They are dated by their modification, the epoch if it is unknown.
    """
    path = F.col("local_path")
    data, logs = (folder.rstrip("/") + "/" for folder in (data_dir, commit_log_dir))
    name = F.substring_index(path, "/", -1)
    beside = path.startswith(data) & (F.concat(F.lit(data), name) == path)
    file_type = (
        F.when(path.startswith(logs), "CL")
        .when(beside & name.rlike(MANIFEST_V2_PATTERN), "META_V2")
        .when(beside & (F.lower(name) == MANIFEST_V1_NAME), "META")
    )
    modified = F.coalesce("modified_ms", F.lit(0)).cast("bigint")
    none = F.lit(None).cast("string")
    found = inventory.withColumn("file_type", file_type).filter(F.col("file_type").isNotNull())
    table = found.withColumns(
        {
            "is_data": F.lit(False),
            "base_dir": F.lit(base_dir),
            "keyspace": none,
            "column_family": none,
            "file_name": name,
            "last_modified_ms": modified,
            "time_ms": modified,
            "size": F.coalesce("size", F.lit(0)).cast("bigint"),
            "compression": F.lit("SNAPPY"),
            "encryption": F.lit("PLAINTEXT"),
        }
    )
    return with_remote_path(table)


def with_remote_path(table: DataFrame) -> DataFrame:
    return table.withColumn("remote_path", remote_path())


def compression_choice(
    candidates: DataFrame, setting: str = "IF_REQUIRED", transition_ms: int = 0
) -> DataFrame:
    """Codec of each candidate.

    Older layouts and files from before the transition are compressed. ``IF_REQUIRED`` leaves
    a file alone when its sstable carries its own compression info. The sstables that do are
    found by one distinct over the few info files and joined, so a hot folder is split like
    any other join input.
    """
    if setting not in ("NONE", "ALL", "IF_REQUIRED"):
        raise ValueError(f"NONE, ALL or IF_REQUIRED expected, got {setting!r}")
    folder = before_last(F.col("local_path"), "/")
    # unlike a manifest prefix, a name without a dash has none here
    prefix = before_last(F.col("file_name"), "-")
    always = ~is_v2(F.col("file_type")) | (F.col("last_modified_ms") < transition_ms)
    if setting != "IF_REQUIRED":
        codec = "NONE" if setting == "NONE" else "SNAPPY"
        return candidates.withColumn("compression", F.when(always, "SNAPPY").otherwise(codec))
    keyed = candidates.withColumns({"dir": folder, "stem": prefix})
    carries = (
        keyed.filter(F.col("file_name").endswith(COMPRESSION_INFO_SUFFIX))
        .select(*NODE, "dir", "stem")
        .distinct()
        .withColumn("own", F.lit(True))
    )
    joined = keyed.join(carries, [*NODE, "dir", "stem"], "left")
    codec = F.when(always, "SNAPPY").when(F.col("own"), "NONE").otherwise("SNAPPY")
    return joined.withColumn("compression", codec).drop("dir", "stem", "own")


def upload_order(candidates: DataFrame) -> DataFrame:
    """Candidates with ``upload_pass``: data files go in the second pass, all others in the first.

    Nothing orders the files of a pass, so the fleet is not sorted; within a partition the
    rows come pass by pass.
    """
    last = F.col("local_path").endswith(DATA_FILE_SUFFIX).cast("int")
    return candidates.withColumn("upload_pass", last).sortWithinPartitions("upload_pass")


def upload_todo(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """Files still to upload: one row per local file, without v2 table files already listed."""
    keys = listing.select("remote_path")
    present = (candidates["remote_path"] == keys["remote_path"]) & (candidates["file_type"] == "SST_V2")
    return candidates.join(keys, present, "left_anti").dropDuplicates([*NODE, "local_path"])


def upload_deadline(
    clusters: DataFrame, as_of_ms: int, target_minutes: int, slo_hours: int = SLO_HOURS
) -> DataFrame:
    """Earliest of the target, the verification objective and the next snapshot.

    ``clusters(cluster, token, last_verified_ms, next_snapshot_ms)``; missing times are ignored.
    """
    deadline = F.least(
        F.lit(as_of_ms + target_minutes * MINUTE_MS),
        F.col("last_verified_ms") + slo_hours * HOUR_MS,
        F.col("next_snapshot_ms"),
    )
    return clusters.withColumn("deadline_ms", deadline)


def snapshot_dir_size(files: DataFrame) -> DataFrame:
    """Bytes below snapshot folders per node."""
    inside = files.filter(F.col("local_path").contains("snapshots"))
    return inside.groupBy(*NODE).agg(F.sum("size").alias("snapshot_bytes"))
