"""Snapshot files to manifest documents.

A node's manifest can list any number of files, so a document is written in parts: each part
is a complete manifest of one node, snapshot and (v2) table that lists a bounded share of the
files. Readers see the union of the parts. The number of parts comes from a count, and the
part of a file from a digest of its name, so no group grows with the data.

What was written is recorded beside the parts, and ``judge_manifests`` holds what is found
against it: only a manifest with all its parts may vouch for a backup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.functions.text import before_last, minute_text, part_of
from snapops.session import kept
from snapops.sources.manifests import manifest_documents

FEW_PATHS = 200_000
HELD_PATHS = 500_000
HELD_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
SORTED_GROUPS = "spark.sql.execution.replaceHashWithSortAgg"
NODE_SNAPSHOT = ["cluster", "token", "snapshot_ms"]
Entries = DataFrame | Callable[[DataFrame], DataFrame]


def sstable_prefix(file_name: Column) -> Column:
    """Name before the last dash; the table's own manifest file counts as ``manifest``."""
    table_manifest = F.when(F.lower(file_name) == "manifest.json", "manifest")
    return F.coalesce(before_last(file_name, "-"), table_manifest)


def mark_uploaded(files: DataFrame, listing: DataFrame, path: str = "backup_path") -> DataFrame:
    """``is_uploaded`` tells whether the object is listed; one shuffle of each side by path."""
    keys = listing.select(F.col("remote_path").alias(path)).distinct().withColumn("listed", F.lit(True))
    return files.join(keys, path, "left").withColumn(
        "is_uploaded", F.coalesce("listed", F.lit(False))
    ).drop("listed")


def mark_wide(files: DataFrame, listing: DataFrame, path: str = "backup_path", few: int = FEW_PATHS) -> DataFrame:
    """``mark_uploaded`` for files of many columns, most of which are listed.

    The distinct paths meet the listing alone and those it lacks are written down. Up to
    ``few`` of them are broadcast, so the files stay where they are; more meet the files in a
    join on the path.
    """
    lacking = files.select(path).filter(F.col(path).isNotNull()).distinct()
    lacking = kept(lacking.join(listing.select(F.col("remote_path").alias(path)), path, "left_anti"), "not-listed")
    if lacking.count() > few:
        return mark_uploaded(files, listing, path)
    marked = files.join(F.broadcast(lacking.withColumn("lacking", F.lit(True))), path, "left")
    return marked.withColumn("is_uploaded", F.col(path).isNotNull() & F.col("lacking").isNull()).drop("lacking")


def build_manifest_v1(files: DataFrame, files_per_part: int = 10_000) -> DataFrame:
    """``(cluster, token, snapshot_ms, part_no, n_files, document)``, a JSON array of object paths.

    The counts, one row a manifest, are written down first, so the files are dealt to parts
    before their one shuffle, which no large manifest can unbalance.
    """
    n_parts = F.ceil(F.count(F.lit(1)) / files_per_part).alias("n_parts")
    sizes = kept(files.groupBy(*NODE_SNAPSHOT).agg(n_parts), "manifest-sizes")
    parts = files.select(*NODE_SNAPSHOT, "backup_path").join(sizes, NODE_SNAPSHOT)
    parts = parts.select(*NODE_SNAPSHOT, "backup_path", part_of(F.col("backup_path"), F.col("n_parts")).alias("part_no"))
    paths = F.sort_array(F.collect_list("backup_path"))
    key = [*NODE_SNAPSHOT, "part_no"]
    return parts.repartition(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("n_files"), F.to_json(paths).alias("document"))


def build_manifest_v2(
    files: DataFrame, listing: DataFrame, sstables_per_part: int = 2_000
) -> DataFrame:
    """``(cluster, token, snapshot_ms, keyspace, column_family, part_no, file_name, n_files, document)``.

    The components of one sstable, a handful by format, are grouped first; the sstables of a
    table are then spread over parts. Files are shuffled once, by table: the count of a table's
    sstables and their parts read that shuffle, the count with a digest of all its columns, or
    it would need a narrower one of its own. A task sorts its files once, first by a number that
    is near-unique for their part, since names are alike, and keeps a table's parts together;
    both groupings follow that order. ``write_manifests`` lets Spark group sorted rows as they
    come, and Spark then leaves the second sort out.
    """
    whole = [*NODE_SNAPSHOT, "keyspace", "column_family"]
    table = [*whole, "region", "rack"]
    named = files.withColumn("prefix", sstable_prefix(F.col("file_name"))).filter(
        F.col("prefix").isNotNull() & F.col("region").isNotNull() & F.col("rack").isNotNull()
    )
    component = F.struct(
        F.col("file_name").alias("fileName"),
        F.col("last_modified_ms").alias("lastModifiedTime"),
        F.col("creation_ms").alias("fileCreationTime"),
        F.col("size").alias("fileSizeOnDisk"),
        F.col("compression"),
        F.col("encryption"),
        F.col("is_uploaded").alias("isUploaded"),
        F.col("backup_path").alias("backupPath"),
    )
    columns = ["file_name", "last_modified_ms", "creation_ms", "size", "compression", "encryption", "is_uploaded", "backup_path"]
    spread = mark_wide(named, listing).select(*table, *columns).repartition(*whole)
    marked = spread.withColumn("prefix", sstable_prefix(F.col("file_name")))
    digests = marked.groupBy(*table, "prefix").agg(F.max(F.xxhash64(*columns)).alias("digest"))
    sizes = digests.groupBy(*table).agg(
        F.ceil(F.count(F.lit(1)) / sstables_per_part).alias("n_parts"), F.max("digest").alias("digest")
    ).filter(F.col("digest").isNotNull()).select(*whole, F.array(F.struct("region", "rack")).alias("of"), "n_parts")
    dealt = marked.join(sizes.hint("shuffle_hash"), whole).filter(F.array_contains("of", F.struct("region", "rack")))
    dealt = dealt.withColumn("part_no", part_of(F.col("prefix"), F.col("n_parts")))
    part = ["part_digest", *whole, "place"]
    place = F.struct("region", "rack", "part_no")
    dealt = dealt.withColumns({"place": place, "part_digest": F.shiftleft(F.xxhash64(*table), 20) + F.col("part_no") % 2**20}).select(*part, "prefix", component.alias("component"))
    in_order = dealt.sortWithinPartitions(*part, "prefix")
    sstables = in_order.groupBy(*part, "prefix").agg(F.sort_array(F.collect_set("component")).alias("sstableComponents"))
    components = F.size("sstableComponents").cast("bigint")
    sstable = F.struct("prefix", "sstableComponents")
    grouped = sstables.sortWithinPartitions(*part).groupBy(*part).agg(F.sum(components).alias("n_files"), F.sort_array(F.collect_list(sstable)).alias("sstables"))
    grouped = grouped.select(*whole, "place.*", "n_files", "sstables")
    document = F.struct(
        F.struct(
            F.lit(1).cast("smallint").alias("version"),
            F.col("cluster").alias("appName"),
            F.col("region"),
            F.col("rack"),
            F.array("token").alias("backupIdentifier"),
        ).alias("info"),
        F.array(
            F.struct(
                F.col("keyspace").alias("keyspaceName"),
                F.col("column_family").alias("columnfamilyName"),
                F.col("sstables"),
            )
        ).alias("data"),
    )
    return grouped.select(
        *NODE_SNAPSHOT,
        "keyspace",
        "column_family",
        "part_no",
        F.concat(F.lit("meta_v2_"), minute_text(F.col("snapshot_ms")), F.lit(".json")).alias("file_name"),
        "n_files",
        F.to_json(document).alias("document"),
    )


def _part_key(parts: DataFrame) -> list[str]:
    return [c for c in ("keyspace", "column_family", "part_no") if c in parts.columns]


@contextmanager
def _parts_held(spark: SparkSession, files_per_part: int | None) -> Iterator[None]:
    """Parts are collected without a sort while a task holds no more than about ``HELD_PATHS`` paths.

    Spark sorts the rows of a task once they are of more than 128 groups, and again to merge
    them. Parts are of bounded size, so a larger number of them fits as well; of more than that
    the rows are sorted as before. Rows that come sorted by their group are grouped as they
    come. A value the session was given is left alone.
    """
    held = HELD_PATHS // files_per_part if files_per_part else 0
    wanted = {SORTED_GROUPS: "true"} | ({HELD_GROUPS: str(held)} if held > 128 else {})
    ours = {name: value for name, value in wanted.items() if spark.conf.get(name, None) is None}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in ours:
            spark.conf.unset(name)


def write_manifests(parts: DataFrame, snapshots: DataFrame, path: str, files_per_part: int | None = None) -> None:
    """Documents below ``path/parts``, then one record per manifest below ``path/record``.

    ``files_per_part`` tells how many paths the v1 parts were dealt, so that a task knows how
    many of them it can hold.

    ``snapshots(cluster, token, snapshot_ms, manifest_path)`` are all that were taken, also
    those without files. The record holds how many parts and files were written and is
    counted from the written parts; it comes last, so a manifest whose writer died has none.
    """
    with _parts_held(parts.sparkSession, files_per_part):
        parts.write.option("compression", "zstd").parquet(f"{path}/parts")
    there = parts.sparkSession.read.schema(parts.schema).parquet(f"{path}/parts")
    written = there.groupBy(*NODE_SNAPSHOT).agg(F.count(F.lit(1)).alias("parts"), F.sum("n_files").alias("files"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(f"{c}_written") for c in ("parts", "files")]
    record = snapshots.select(*NODE_SNAPSHOT, "manifest_path").distinct().join(written, NODE_SNAPSHOT, "left")
    record.select(*NODE_SNAPSHOT, "manifest_path", *counts).write.parquet(f"{path}/record")


def judge_manifests(parts: DataFrame, record: DataFrame) -> DataFrame:
    """One verdict per recorded manifest: ``available`` if every part is there and could be read.

    ``parts`` are the documents found, ``record`` what was written. A lost part, an unreadable
    one and one that lists fewer files than were written all make the manifest unavailable;
    a part found twice counts once. Documents without a record belong to no manifest.
    """
    key = [*NODE_SNAPSHOT, *_part_key(parts)]
    read = manifest_documents(parts.select(*key, "document"), v2="keyspace" in key, key=key)
    once = read.groupBy(*key).agg(F.min("readable").alias("readable"), F.max("n_entries").alias("n_entries"))
    found = once.groupBy(*NODE_SNAPSHOT).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n_entries").alias("files"), F.min("readable").alias("readable")
    )
    joined = record.join(found, NODE_SNAPSHOT, "left")
    parts_read, files_read = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("parts", "files"))
    whole = (parts_read == F.col("parts_written")) & (files_read == F.col("files_written")) & F.coalesce("readable", F.lit(True))
    return joined.select(
        *NODE_SNAPSHOT, "manifest_path", "parts_written", parts_read.alias("parts_read"), "files_written", files_read.alias("files_read"), whole.alias("available")
    )


def entries_of(entries: Entries, manifests: DataFrame) -> DataFrame:
    """Entries of the given manifests, of which a few columns and ``manifest_path`` are known.

    ``entries`` are rows, or a function that reads the entries of the manifests it is given:
    Spark takes a join below one exploded array and no further, so only a reader that knows
    the manifests leaves the documents of the others unparsed.
    """
    asked = manifests.select("manifest_path").distinct()
    return entries(asked) if callable(entries) else entries.join(asked, "manifest_path", "left_semi")


def snapshot_paths(entries: Entries, manifests: DataFrame) -> DataFrame:
    """Object paths the given manifests list, as a listing for ``build_catalog``."""
    chosen = kept(manifests.select("manifest_path").distinct(), "chosen")
    return entries_of(entries, chosen).select(
        F.col("backup_path").alias("remote_path"),
        F.col("size"),
        F.lit(None).cast("bigint").alias("modified_ms"),
    )
