"""Object listings and local file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.functions.text import computed_once
from snapops.schemas import LISTING


def read_listing(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """An inventory table of an object store, in Parquet, ORC, CSV or JSON."""
    reader = spark.read.schema(LISTING).format(source)
    if source == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def save_listing(listing: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """The listing clustered by key, so that a prefix and a marker prune files by their statistics."""
    rows = listing.repartitionByRange("remote_path").sortWithinPartitions("remote_path")
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_file_tree(spark: SparkSession, root: str) -> DataFrame:
    """A listing of the files below a folder any Spark file system can reach.

    Only the file status columns are selected, so no content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.col("path").alias("remote_path"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified_ms"),
    )


def scan_listing(listing: DataFrame, prefix: str, marker: str | None = None) -> DataFrame:
    """Keys below ``prefix``, after ``marker``; both conditions reach the Parquet scan."""
    keys = listing.filter(F.col("remote_path").startswith(prefix))
    return keys if marker is None else keys.filter(F.col("remote_path") > marker)


def _part(parts: Column, index: int) -> Column:
    return F.try_element_at(parts, F.lit(index + 1))


def scan_data_dir(inventory: DataFrame, data_dir: str, folder: str | None = None) -> DataFrame:
    """Files of a node's data folder with keyspace, table, folder and snapshot name.

    ``folder`` keeps one of ``snapshots`` and ``backups``; None keeps every file of a table,
    also those that lie directly in the table's folder.
    """
    root = data_dir.rstrip("/") + "/"
    below = F.expr(f"substr(local_path, {len(root) + 1})")
    files = inventory.filter(F.col("local_path").startswith(root)).withColumn(
        "parts", F.split(below, "/")
    )
    parts = F.col("parts")
    sub = _part(parts, 2)
    in_folder = (F.size(parts) > 3) & sub.isin("snapshots", "backups")
    files = computed_once(
        files,
        [
            *inventory.columns,
            F.size(parts).alias("depth"),
            _part(parts, 0).alias("keyspace"),
            _part(parts, 1).alias("table_dir"),
            F.substring_index(_part(parts, 1), "-", 1).alias("column_family"),
            F.when(in_folder, sub).alias("folder"),
            F.when(in_folder & (sub == "snapshots"), _part(parts, 3)).alias("snapshot_name"),
            F.element_at(parts, -1).alias("file_name"),
        ],
    ).filter(F.col("depth") >= 3)
    if folder is not None:
        files = files.filter(F.col("folder") == folder)
    return files.drop("depth")
