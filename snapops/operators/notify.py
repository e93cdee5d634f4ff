"""Messages about uploads and verified snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.constants import FILE_TYPES

# Field names of the messages.
UPLOAD_FIELDS = {
    "s3bucketname": "bucket",
    "s3clustername": "cluster",
    "s3namespace": "remote_path",
    "keyspace": "keyspace",
    "cf": "column_family",
    "region": "region",
    "rack": "rack",
    "token": "token",
    "filename": "file_name",
    "uncompressfilesize": "size",
    "compressfilesize": "compressed_size",
    "backuptype": "file_type",
    "uploadstatus": "upload_status",
    "compression": "compression",
    "encryption": "encryption",
    "isincremental": "is_incremental",
}
VERIFIED_FIELDS = {
    "s3bucketname": "bucket",
    "s3clustername": "cluster",
    "s3namespace": "remote_path",
    "region": "region",
    "rack": "rack",
    "token": "token",
    "backuptype": "file_type",
    "snapshotInstant": "snapshot_instant",
}
ALWAYS_ATTRIBUTES = ["s3clustername", "backuptype"]


def included_types(include: str | None) -> list[str]:
    """Known types of a comma list; unknown names are ignored."""
    names = [name.strip() for name in (include or "").split(",")]
    return [name for name in FILE_TYPES if name in names]


def _messages(rows: DataFrame, fields: dict[str, str], extra: list[str]) -> DataFrame:
    def value(name: str) -> Column:
        column = F.col(fields[name])
        return F.lower(column) if name == "uploadstatus" else column

    body = F.to_json(F.struct(*[value(name).alias(name) for name in fields]))
    names = ALWAYS_ATTRIBUTES + [n for n in extra if n in fields and n not in ALWAYS_ATTRIBUTES]
    pairs = []
    for name in names:
        pairs += [F.lit(name), value(name).cast("string")]
    attributes = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return rows.select("remote_path", body.alias("message"), attributes.alias("attributes"))


def upload_notifications(
    uploads: DataFrame, include: str | None = None, extra_attributes: list[str] | None = None
) -> DataFrame:
    """A message per upload change of the included types; without a valid type, of all."""
    types = included_types(include)
    rows = uploads.filter(F.col("file_type").isin(types)) if types else uploads
    return _messages(rows, UPLOAD_FIELDS, extra_attributes or [])


def verified_notifications(
    snapshots: DataFrame, extra_attributes: list[str] | None = None
) -> DataFrame:
    """A message per verified snapshot."""
    rows = snapshots.withColumn("file_type", F.lit("SNAPSHOT_VERIFIED"))
    return _messages(rows, VERIFIED_FIELDS, extra_attributes or [])


def as_topic_rows(messages: DataFrame, topic: str) -> DataFrame:
    """Messages in the column layout of Spark's message-queue sink."""
    headers = F.transform(
        F.map_entries("attributes"),
        lambda e: F.struct(e["key"].alias("key"), F.to_binary(e["value"], F.lit("utf-8")).alias("value")),
    )
    return messages.select(
        F.lit(topic).alias("topic"),
        F.col("remote_path").alias("key"),
        F.col("message").alias("value"),
        headers.alias("headers"),
    )


def notify_sink(messages: DataFrame, path: str, batch: int) -> None:
    """Write a batch of messages as JSON lines, then the record that makes them count.

    A batch that failed before its record was written is invisible; run again under its number
    it replaces its own files, so each message is read once however often a batch is tried.
    """
    rows = messages.select("remote_path", "message", F.to_json("attributes").alias("attributes"))
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/messages/batch={batch}")
    commit(messages.sparkSession, path, batch)


def commit(spark: SparkSession, path: str, batch: int) -> None:
    spark.range(batch, batch + 1, 1, 1).write.mode("overwrite").parquet(f"{path}/committed/batch={batch}")


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the committed batches, in the form ``as_topic_rows`` takes."""
    schema = "remote_path string, message string, attributes string, batch bigint"
    done = spark.read.schema("id bigint, batch bigint").parquet(f"{path}/committed").select("batch").distinct()
    rows = spark.read.schema(schema).json(f"{path}/messages").join(done, "batch", "left_semi")
    return rows.select("remote_path", "message", F.from_json("attributes", "map<string,string>").alias("attributes"))
