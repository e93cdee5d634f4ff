"""Manifest documents to one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.constants import MANIFEST_V2_PATTERN
from snapops.schemas import MANIFEST_V1_JSON, MANIFEST_V2_JSON


def read_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """``(manifest_path, file_name, document)``; one whole-text file is one row.

    Parts written by :func:`snapops.operators.manifests.build_manifest_v2` are of bounded
    size, so a row always fits a task.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("manifest_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("document"),
    )


def manifest_documents(manifests: DataFrame, v2: bool = True, key: list[str] | None = None) -> DataFrame:
    """``(manifest_path, readable, n_entries)``, one row per document; ``key`` names other columns to keep.

    A document is readable if it parses and, for v2, names its node and has data; an
    unreadable one has no entries, which must not pass for an empty backup.
    """
    key = key or ["manifest_path"]
    if v2:
        rows = manifests.select(*key, F.from_json("document", MANIFEST_V2_JSON).alias("m"))
        readable = F.col("m.info.appName").isNotNull() & (F.size("m.info.backupIdentifier") > 0) & F.col("m.data").isNotNull()
        tables = F.flatten(F.transform("m.data", lambda f: f["sstables"]))
        entries = F.size(F.flatten(F.transform(tables, lambda s: s["sstableComponents"])))
    else:
        rows = manifests.select(*key, F.from_json("document", MANIFEST_V1_JSON).alias("m"))
        readable, entries = F.col("m").isNotNull(), F.size("m")
    good = F.coalesce(readable, F.lit(False))
    return rows.select(*key, good.alias("readable"), F.when(good, F.greatest(entries, F.lit(0))).otherwise(0).cast("bigint").alias("n_entries"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Documents that :func:`snapops.operators.manifests.write_manifests` wrote."""
    return spark.read.parquet(f"{path}/parts")


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """How many parts and files each manifest was written with."""
    return spark.read.parquet(f"{path}/record")


def save_entries(entries: DataFrame, path: str) -> None:
    """Manifest rows as typed columns, clustered by snapshot time and manifest.

    A document is parsed once; later jobs read the columns and snapshots they ask for.
    """
    order = ["snapshot_ms", "manifest_path", "backup_path"]
    entries.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def read_manifest_v2(manifests: DataFrame) -> DataFrame:
    """Rows of the nested documents; files not named like a v2 manifest are skipped.

    A document is parsed once, behind a one-row generator: the filters Spark infers for exploded
    arrays would parse it again for each, and before a join that needs few of the documents.
    The carried columns stay outside, so that filters and such joins come before the parsing.
    """
    carried = [c for c in manifests.columns if c not in ("document", "file_name")]
    named = manifests.filter(F.col("file_name").rlike(MANIFEST_V2_PATTERN))
    parsed = named.select(*carried, F.inline(F.array(F.struct(F.from_json("document", MANIFEST_V2_JSON).alias("m")))))
    families = parsed.select(
        *carried,
        F.col("m.info.appName").alias("cluster"),
        F.element_at("m.info.backupIdentifier", 1).alias("token"),
        F.explode("m.data").alias("f"),
    )
    tables = families.select(
        *carried,
        "cluster",
        "token",
        F.col("f.keyspaceName").alias("keyspace"),
        F.col("f.columnfamilyName").alias("column_family"),
        F.explode("f.sstables").alias("s"),
    )
    files = tables.select(
        *carried,
        "cluster",
        "token",
        "keyspace",
        "column_family",
        F.col("s.prefix").alias("prefix"),
        F.explode("s.sstableComponents").alias("c"),
    )
    return files.select(
        *carried,
        "cluster",
        "token",
        "keyspace",
        "column_family",
        "prefix",
        F.col("c.fileName").alias("file_name"),
        F.col("c.lastModifiedTime").alias("last_modified_ms"),
        F.col("c.fileCreationTime").alias("creation_ms"),
        F.col("c.fileSizeOnDisk").alias("size"),
        F.col("c.compression").alias("compression"),
        F.col("c.encryption").alias("encryption"),
        F.col("c.isUploaded").alias("is_uploaded"),
        F.col("c.backupPath").alias("backup_path"),
    )


def read_manifest_v1(manifests: DataFrame) -> DataFrame:
    """One row per path of the flat documents."""
    carried = [c for c in manifests.columns if c not in ("document", "file_name")]
    paths = F.from_json("document", MANIFEST_V1_JSON)
    return manifests.select(*carried, F.explode(paths).alias("backup_path"))
