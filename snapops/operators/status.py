"""Backup run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapops.constants import DAY_MS, SNAPSHOT_BACKUP, STATUS_DAYS
from snapops.functions.text import day_text, floor_to, minute_text
from snapops.ranges import DateRange

NODE = ["cluster", "token"]
RUN_KEY = [*NODE, "version", "start_ms"]


def valid_events(events: DataFrame) -> DataFrame:
    """Run events that name a run; a record without token or start is refused."""
    return events.filter(F.col("start_ms").isNotNull() & (F.length("token") > 0))


def status_fold(events: DataFrame) -> DataFrame:
    """Current record of each run from its start, finish, fail and update events.

    The last event wins; a run keeps the first completion it was given, also if it is reported
    complete again. Both are partial
    aggregates, so a run with many events costs one row per task in the shuffle.
    """
    return run_records(merge_partials(run_partials(events)))


LAST = ["status", "snapshot_ok", "location", "last_validated_ms"]


def run_partials(events: DataFrame) -> DataFrame:
    """One row per event in the form in which runs are folded: what it says last, and what it completes."""
    done = F.col("status").isin("FINISHED", "FAILED")
    completion = F.coalesce(F.col("completed_ms"), F.when(done, F.col("event_ms")))
    return valid_events(events).select(
        *RUN_KEY,
        F.col("seq").alias("last_seq"),
        F.struct(*LAST).alias("last"),
        F.when(completion.isNotNull(), F.col("seq")).alias("completed_seq"),
        completion.alias("completed_ms"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """One row per run; the result can be merged again with later events."""
    return partials.groupBy(*RUN_KEY).agg(
        F.max("last_seq").alias("last_seq"),
        F.max_by("last", "last_seq").alias("last"),
        F.min("completed_seq").alias("completed_seq"),
        F.min_by("completed_ms", "completed_seq").alias("completed_ms"),
    )


def run_records(partials: DataFrame) -> DataFrame:
    return partials.select(*RUN_KEY, day_text(F.col("start_ms")).alias("snapshot_date"), "completed_ms", "last.*")


def finished_runs(status: DataFrame, version: int, span: DateRange) -> DataFrame:
    return status.filter(
        (F.col("status") == "FINISHED")
        & (F.col("version") == version)
        & F.col("start_ms").between(span.start_ms, span.end_ms)
    )


def latest_backup_metadata(status: DataFrame, version: int, span: DateRange) -> DataFrame:
    """Finished runs that started in the closed range, newest first."""
    return finished_runs(status, version, span).orderBy(F.desc("start_ms"))


def status_by_day(status: DataFrame, version: int = SNAPSHOT_BACKUP) -> DataFrame:
    """Per node and day: whether a run finished, and the newest that did.

    A day reaches to the next midnight inclusive, so a run that starts at midnight also
    counts for the day before.
    """
    start = F.col("start_ms")
    day = floor_to(start, DAY_MS)
    days = F.when(start == day, F.array(day, day - DAY_MS)).otherwise(F.array(day))
    finished = (F.col("status") == "FINISHED") & (F.col("version") == version)
    detail = F.struct("start_ms", "completed_ms", "location")
    return (
        status.withColumn("finished", finished)
        .withColumn("day_ms", F.explode(days))
        .groupBy(*NODE, "day_ms")
        .agg(
            F.max("finished").alias("has_finished"),
            F.max_by(detail, F.when(F.col("finished"), F.col("start_ms"))).alias("d"),
        )
        .select(*NODE, day_text(F.col("day_ms")).alias("day"), "has_finished", "d.*")
    )


def snapshots_by_day(status: DataFrame, version: int = SNAPSHOT_BACKUP) -> DataFrame:
    """Start minutes of the runs of each day, one row per run whatever its outcome."""
    return status.filter(F.col("version") == version).select(
        *NODE, "snapshot_date", minute_text(F.col("start_ms")).alias("started")
    )


def keep_last_days(status: DataFrame, order: str, days: int = STATUS_DAYS) -> DataFrame:
    """Runs of the ``days`` day buckets each node opened last.

    The rank runs over one row per node and day, never over the runs themselves.
    """
    buckets = status.groupBy(*NODE, "snapshot_date").agg(F.min(order).alias("opened"))
    newest = Window.partitionBy(*NODE).orderBy(F.desc("opened"), F.desc("snapshot_date"))
    kept = buckets.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= days)
    return status.join(kept.select(*NODE, "snapshot_date"), [*NODE, "snapshot_date"], "left_semi")


def save_status(status: DataFrame, path: str) -> None:
    """Write the days the frame holds and leave all other days of the store as they are.

    The range cut keeps a small day in one file and splits a large one over several tasks.
    """
    (
        status.repartitionByRange("snapshot_date", "token", "start_ms")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def load_status(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The store, or one day of it; the day prunes folders."""
    stored = spark.read.option("basePath", path).parquet(path)
    stored = stored.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))
    return stored if day is None else stored.filter(F.col("snapshot_date") == day)
