"""The polling jobs as Structured Streaming queries.

Wherever the batch operator is an aggregate, the stream runs the very same function. Results
are written per micro-batch under the batch number, so a repeated batch replaces itself. What
a stream remembers is keyed: paths in a state store on disk, run records in a table by day.
No batch reads what earlier ones wrote, but for the days it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapops.operators.filters import drop_empty_incrementals, filter_keyspace_table
from snapops.operators.health import health_status
from snapops.operators.notify import notify_sink, upload_notifications
from snapops.operators.status import merge_partials, run_partials, run_records

#: Keyed state lives in a store on the executors' disks; its files are not allocated ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1_000) -> DataFrame:
    """Parquet files that arrive in a folder, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Hand ``each`` every micro-batch of what is there now and its number, then stop."""
    with state_on_disk(stream.sparkSession):
        writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def run_available(
    stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None
) -> StreamingQuery:
    """Process everything that is there now and stop; one folder per micro-batch below ``path``.

    The folder of an empty batch is written first, so a source without files reads as no rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        out = each(batch, batch_id) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    empty = spark.createDataFrame([], stream.schema)
    write_none = each(empty, -1) if each else empty
    write_none.write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    return run_batches(stream, path, write, mode)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last version of each key an update stream wrote."""
    rows = spark.read.parquet(f"{path}/rows")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")


def stream_incrementals(
    files: DataFrame, listing: DataFrame, path: str, include: str | None = None, exclude: str | None = None
) -> StreamingQuery:
    """Upload rows for new incremental files, each once: no empty ones, no filtered tables.

    Paths seen are keyed state without expiry, so a file is known however late it comes again,
    and a batch costs a look-up for each of its rows. The listing enters that state in the
    first batch, as a stream of its own; a table file it holds is not uploaded.
    """
    spark = files.sparkSession
    wanted = filter_keyspace_table(drop_empty_incrementals(files), include, exclude)
    columns = wanted.columns
    known = f"{path}/known"
    listing.select("remote_path").distinct().write.mode("ignore").parquet(known)
    listed = spark.readStream.schema("remote_path string").parquet(known)
    listed = listed.select(*(F.col(c) if c == "remote_path" else F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in columns))
    both = wanted.withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True)))
    # Only table files are looked up in the listing; other types are uploaded whatever it holds.
    blocking = F.col("listed") | (F.col("file_type") == "SST_V2")
    seen = both.withColumn("blocking", F.coalesce(blocking, F.lit(False))).dropDuplicates(["remote_path", "blocking"])

    def new(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = batch.filter("NOT listed")
        if batch_id <= 0:
            there = batch.sparkSession.read.schema("remote_path string").parquet(known)
            rows = rows.alias("r").join(there.alias("k"), F.expr("r.remote_path = k.remote_path AND r.blocking"), "left_anti")
        return rows.select(*columns)

    return run_available(seen, path, each=new)


def stream_status(events: DataFrame, path: str, period: str = "yyyyMMdd") -> StreamingQuery:
    """Run records in a table by day, brought up to date by every batch of events.

    A batch folds its events, merges them with the records of the days they belong to and
    writes those days anew; a small table then names the batch that holds each day. Nothing
    else is read or rewritten, and there is no state beside the table. A batch that is run
    again starts from the days as the batches before it left them. ``period`` is the pattern
    of the table's parts: days, or months where a batch brings years of sparse history.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.date_format(F.timestamp_millis("start_ms"), period)
        fresh = merge_partials(run_partials(batch))
        current = part_batches(spark, path, batch_id)
        parts = {r.part for r in fresh.select(part.alias("part")).distinct().collect()}
        held = {d: b for d, b in current.items() if d in parts}
        merged = merge_partials(_read_parts(spark, path, held).unionByName(fresh)) if held else fresh
        rows = merged.withColumn("part", part).repartitionByRange("part", "cluster", "token", "start_ms")
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/runs/batch={batch_id}")
        named = [(d, int(b)) for d, b in (current | dict.fromkeys(parts, batch_id)).items()]
        spark.createDataFrame(named, PARTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")

    events.sparkSession.createDataFrame([], PARTS).write.mode("overwrite").parquet(f"{path}/parts/batch=-1")
    return run_batches(events, path, write)


PARTS = "part string, in_batch long"
PARTIAL = (
    "cluster string, token string, version int, start_ms bigint, last_seq bigint, "
    "last struct<status: string, snapshot_ok: boolean, location: string, last_validated_ms: bigint>, "
    "completed_seq bigint, completed_ms bigint"
)


def part_batches(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """The batch that holds each part, as of the last one committed (before the given one)."""
    rows = spark.read.schema(f"{PARTS}, batch long").parquet(f"{path}/parts")
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return {} if last is None else {r.part: r.in_batch for r in rows.filter(F.col("batch") == last).collect()}


def _read_parts(spark: SparkSession, path: str, held: dict[str, int]) -> DataFrame:
    folders = [f"{path}/runs/batch={b}/part={d}" for d, b in sorted(held.items())]
    return spark.read.schema(PARTIAL).parquet(*folders)


def read_runs(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """The records ``stream_status`` keeps, of one part or of all; as many rows are read as there are runs."""
    held = {d: b for d, b in part_batches(spark, path).items() if part in (None, d)}
    return run_records(_read_parts(spark, path, held) if held else spark.createDataFrame([], PARTIAL))


def stream_notifications(uploads: DataFrame, path: str, include: str | None = None, extra: list[str] | None = None) -> StreamingQuery:
    """Messages about uploads, each in the sink once."""
    messages = upload_notifications(uploads, include, extra)
    notify_sink(uploads.sparkSession.createDataFrame([], messages.schema), path, -1)
    return run_batches(messages, path, lambda batch, number: notify_sink(batch, path, number))


def stream_health(flags: DataFrame, path: str) -> None:
    """Health of a node, recomputed on every flag change."""
    run_available(health_status(flags), path, "update")


def windowed_metrics(events: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Transfer metrics per time window."""
    return (
        events.groupBy(F.window("ts", size).alias("w"), "node", "kind")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("size").alias("total_size"),
            F.max("size").alias("max_size"),
        )
        .select(
            F.unix_millis("w.start").alias("window_ms"), "node", "kind", "events", "total_size", "max_size"
        )
    )


def stream_metrics(events: DataFrame, path: str, size: str = "10 minutes") -> None:
    """Partial metrics of each micro-batch; events count however late they are."""
    run_available(events, path, each=lambda batch, _: windowed_metrics(batch, size))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all batches, their partial rows added up."""
    parts = spark.read.parquet(f"{path}/rows").groupBy("window_ms", "node", "kind")
    return parts.agg(
        F.sum("events").alias("events"), F.sum("total_size").alias("total_size"), F.max("max_size").alias("max_size")
    )
