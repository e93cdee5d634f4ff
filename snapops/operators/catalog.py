"""Object listing to typed catalog, and back to object paths.

Layouts of an object path::

    v1  base/region/cluster/token/yyyyMMddHHmm/TYPE/[keyspace/table/]file
    v2  base/hash_cluster/token/TYPE/last_modified_ms/[keyspace/table/]compression/encryption/file

Parsing is narrow: no shuffle, one pass over the listing. ``save_catalog`` shuffles once, so that
every later job starts from typed columns and reads only the types and times it asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.constants import COMPRESSIONS, DATA_TYPES, ENCRYPTIONS, FILE_TYPES, SECOND_MS, V2_TYPES
from snapops.functions.text import computed_once, floor_to, hashed_cluster, instant_ms, minute_text
from snapops.schemas import CATALOG

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def first_type_in(path: Column) -> Column:
    """First known type that appears as a folder, searched in the fixed order of types."""
    return F.coalesce(
        *[F.when(path.contains(f"/{name}/"), F.lit(name)) for name in FILE_TYPES], F.lit("")
    )


def is_data(file_type: Column) -> Column:
    return file_type.isin(DATA_TYPES)


def is_v2(file_type: Column) -> Column:
    return file_type.isin(V2_TYPES)


def _part(index: int) -> Column:
    return F.try_element_at("parts", F.lit(index + 1))


def build_catalog(listing: DataFrame) -> DataFrame:
    """Every listed object as a catalog row; ``error`` tells why a path could not be read."""
    path = F.trim(F.col("remote_path"), F.lit("/"))
    parts = listing.withColumns(
        {
            "parts": F.when(path.contains("//"), F.split(path, "/+")).otherwise(F.split(path, "/")),
            "v2": is_v2(first_type_in(F.col("remote_path"))),
        }
    )
    v2 = F.col("v2")
    named = parts.withColumns(
        {
            "n_parts": F.size("parts"),
            "file_type": F.when(v2, _part(3)).otherwise(_part(5)),
            "hashed": F.when(v2, _part(1)),
            "token": F.when(v2, _part(2)).otherwise(_part(3)),
        }
    )
    data = is_data(F.col("file_type"))
    shift = F.when(data, 2).otherwise(0)
    named = named.withColumns(
        {
            "base_dir": _part(0),
            "region": F.when(~v2, _part(1)),
            # the folder is ``<hash>_<cluster>``; the cluster itself may contain underscores
            "cluster": F.when(v2, F.expr("substr(hashed, instr(hashed, '_') + 1)")).otherwise(_part(2)),
            "time_ms": F.when(~v2, instant_ms(_part(4))),
            "last_modified_ms": F.when(v2, _part(4).try_cast("bigint")),
            "keyspace": F.when(data, F.when(v2, _part(5)).otherwise(_part(6))),
            "column_family": F.when(data, F.when(v2, _part(6)).otherwise(_part(7))),
            "compression": F.when(v2, F.try_element_at("parts", shift + 6)),
            "encryption": F.when(v2, F.try_element_at("parts", shift + 7)),
            "file_name": F.when(v2, F.try_element_at("parts", shift + 8)).otherwise(
                F.try_element_at("parts", F.lit(-1))
            ),
        }
    )
    # a column of its own: Spark compiles no step that folds an array, and the one below is the long one
    named = named.withColumn("other_hash", F.when(v2, F.col("hashed") != hashed_cluster(F.col("cluster"))))
    least_parts = F.when(v2, F.when(data, 10).otherwise(8)).otherwise(F.when(data, 8).otherwise(7))
    error = F.coalesce(
        F.when(F.col("n_parts") < least_parts, "too_few_parts"),
        F.when(~F.coalesce(F.col("file_type").isin(FILE_TYPES), F.lit(False)), "unknown_type"),
        F.when(v2 & F.col("other_hash"), "bad_cluster_hash"),
        F.when(v2 & F.col("last_modified_ms").isNull(), "bad_last_modified"),
        F.when(v2 & ~F.col("compression").isin(COMPRESSIONS), "unknown_compression"),
        F.when(v2 & ~F.col("encryption").isin(ENCRYPTIONS), "unknown_encryption"),
    )
    return computed_once(
        named,
        [
            "remote_path",
            "base_dir",
            "region",
            "cluster",
            "token",
            "file_type",
            "keyspace",
            "column_family",
            "file_name",
            "time_ms",
            "last_modified_ms",
            "compression",
            "encryption",
            "size",
            v2.alias("is_v2"),
            data.alias("is_data"),
            error.alias("error"),
        ],
    )


def valid_rows(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("error").isNull())


def rejected_rows(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("error").isNotNull()).select("remote_path", "error")


def restore_target(data_dir: str, commit_log_dir: str) -> Column:
    """Local file a restore writes an object to."""
    name = F.col("file_name")
    return (
        F.when(F.col("file_type") == "CL", F.concat_ws("/", F.lit(commit_log_dir), name))
        .when(F.col("file_type").isin("META", "META_V2"), F.concat_ws("/", F.lit(data_dir), name))
        .otherwise(F.concat_ws("/", F.lit(data_dir), "keyspace", "column_family", name))
    )


def _joined(*parts: Column | str) -> Column:
    """Path of the parts that are not null."""
    return F.concat_ws("/", *parts)


def v1_path() -> Column:
    data = F.col("is_data")
    return _joined(
        F.col("base_dir"),
        F.col("region"),
        F.col("cluster"),
        F.col("token"),
        minute_text(F.col("time_ms")),
        F.col("file_type"),
        F.when(data, F.col("keyspace")),
        F.when(data, F.col("column_family")),
        F.col("file_name"),
    )


def v2_path() -> Column:
    data = F.col("is_data")
    return _joined(
        F.col("base_dir"),
        hashed_cluster(F.col("cluster")),
        F.col("token"),
        F.col("file_type"),
        floor_to(F.col("last_modified_ms"), SECOND_MS).cast("string"),
        F.when(data, F.col("keyspace")),
        F.when(data, F.col("column_family")),
        F.col("compression"),
        F.col("encryption"),
        F.col("file_name"),
    )


def remote_path() -> Column:
    """Object path of a catalog row, in the layout its type belongs to."""
    return F.when(is_v2(F.col("file_type")), v2_path()).otherwise(v1_path())


def reencode_catalog(catalog: DataFrame) -> DataFrame:
    """Path rebuilt from the parsed columns, and whether it equals the listed one."""
    encoded = catalog.withColumn("encoded_path", remote_path())
    return encoded.withColumn("round_trips", F.col("encoded_path") == F.col("remote_path"))


def migrate_to_v2(catalog: DataFrame, compression: str = "SNAPPY") -> DataFrame:
    """v2 path each v1 table file or manifest would get; other v1 types have no v2 form."""
    target = F.when(F.col("file_type").isin("SNAP", "SST"), "SST_V2").when(
        F.col("file_type") == "META", "META_V2"
    )
    moved = (
        catalog.filter(~F.col("is_v2"))
        .withColumn("v1_path", F.col("remote_path"))
        .withColumns(
            {
                "file_type": target,
                "last_modified_ms": F.col("time_ms"),
                "compression": F.lit(compression),
                "encryption": F.lit("PLAINTEXT"),
            }
        )
        .filter(F.col("file_type").isNotNull() & F.col("time_ms").isNotNull())
    )
    return moved.select("v1_path", v2_path().alias("v2_path"))


def token_prefixes(listing: DataFrame, cluster_prefix: str | None = None) -> DataFrame:
    """Distinct token folders of the v1 layout, optionally below ``base/region/cluster/``."""
    if cluster_prefix:
        listing = listing.filter(F.col("remote_path").startswith(cluster_prefix.rstrip("/") + "/"))
    parts = listing.select(F.split(F.trim(F.col("remote_path"), F.lit("/")), "/+").alias("parts"))
    names = ["base_dir", "region", "cluster", "token"]
    return (
        parts.filter(F.size("parts") >= 4)
        .select(*[_part(i).alias(name) for i, name in enumerate(names)])
        .distinct()
    )


def save_catalog(catalog: DataFrame, path: str, rows_per_file: int = 5_000_000, in_order: bool = False) -> None:
    """Typed table in folders by layout and type, clustered by time inside each folder.

    The range repartition cuts along layout, type, time and path, so a type with most of the
    objects is spread over many files, each with a narrow time range in its statistics. A
    later filter on type opens the folders of that type only, one on time the files of that
    time. ``in_order`` keeps the rows where they are, for a listing whose order is worth keeping:
    nothing is shuffled or sorted, each task has a file open for each of the few types.
    """
    rows = catalog.select(*_names(CATALOG))
    conf = catalog.sparkSession.conf
    before = conf.get(OPEN_FILES, None)
    if in_order:
        conf.set(OPEN_FILES, 2 * len(FILE_TYPES))
    else:
        order = ["is_v2", "file_type", F.coalesce("last_modified_ms", "time_ms"), "remote_path"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    try:
        writer = rows.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
        writer.partitionBy("is_v2", "file_type").parquet(path)
    finally:
        if in_order:
            conf.unset(OPEN_FILES) if before is None else conf.set(OPEN_FILES, before)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_catalog`` wrote; filters on layout, type and time prune folders and files."""
    return spark.read.schema(CATALOG).parquet(path).select(*_names(CATALOG))


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]
