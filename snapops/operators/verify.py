"""Manifests against the listing: which backups are complete."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapops.constants import HOUR_MS, MANIFEST_V1_NAME, MINUTE_MS, SLO_HOURS
from snapops.functions.text import floor_to
from snapops.operators.manifests import Entries, entries_of, mark_uploaded
from snapops.operators.status import finished_runs
from snapops.ranges import DateRange
from snapops.session import kept

NODE = ["cluster", "token"]


def missing_files(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per listed-in-manifest-only path; this can be long, so it is never a list.

    The listing is merged, whatever size Spark takes it for: packed paths are many times
    their files in memory, too many to send to every task.
    """
    keys = listing.select(F.col("remote_path").alias("backup_path")).hint("merge")
    return entries.join(keys, "backup_path", "left_anti").select("manifest_path", "backup_path")


def _verdicts(manifests: DataFrame, counts: DataFrame) -> DataFrame:
    matched = F.coalesce("matched", F.lit(0)).cast("bigint")
    missing = F.coalesce("missing", F.lit(0)).cast("bigint")
    return (
        manifests.join(counts, "manifest_path", "left")
        .withColumns({"files_matched": matched, "files_in_manifest_only": missing})
        .drop("matched", "missing")
    )


def verify_manifest_v2(manifests: DataFrame, entries: Entries, listing: DataFrame, asked: bool = False) -> DataFrame:
    """Verdict per manifest of ``manifests(manifest_path, …, snapshot_ms, available)``.

    Manifests and objects meet in one join on the object path, a near-unique key; the counts
    per manifest are combined before the second shuffle. ``asked`` says that ``manifests`` are
    a few of those in ``entries``: entries of the others then go before they meet the listing.
    The asked ones, a row each, are written down, so the entries meet them by their measured
    size and stay where they are; ``entries`` may then be a function that reads those of the
    manifests it is given.
    """
    if asked:
        manifests = kept(manifests, "asked-manifests")
        entries = entries_of(entries, manifests)
    marked = mark_uploaded(entries.select("manifest_path", "backup_path"), listing)
    counts = marked.groupBy("manifest_path").agg(
        F.count_if("is_uploaded").alias("matched"),
        F.count_if(~F.col("is_uploaded")).alias("missing"),
    )
    return _verdicts(manifests, counts).withColumn(
        "valid", F.col("available") & (F.col("files_in_manifest_only") == 0)
    )


def verify_manifest_v1(manifests: DataFrame, entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Verdict per v1 manifest from the objects listed for exactly its minute.

    Matches count as a bag, so a path listed twice on both sides counts twice; a path is
    missing when the snapshot's objects lack it altogether. A minute without any object is
    invalid, one without table files on either side is valid. The manifests, a row each, are
    written down with a number, so entries and objects meet them by their measured size. Both
    are then shuffled once, by path, and counted together under number and path.
    """
    minute = floor_to(F.col("snapshot_ms"), MINUTE_MS)
    wanted = kept(manifests.withColumns({"time_ms": minute, "manifest_no": F.monotonically_increasing_id()}), "wanted-manifests")
    listed = catalog.filter(~F.col("is_v2")).select(*NODE, "time_ms", "file_type", "remote_path")
    any_object = listed.groupBy(*NODE, "time_ms").agg(F.count(F.lit(1)).alias("n_listed"))
    snaps = listed.filter((F.col("file_type") == "SNAP") & F.col("remote_path").isNotNull()).join(
        wanted.select("manifest_no", *NODE, "time_ms"), [*NODE, "time_ms"]
    )
    expected = entries.repartition("backup_path").join(wanted.select("manifest_no", "manifest_path"), "manifest_path")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    there = snaps.select("manifest_no", F.col("remote_path").alias("backup_path")).repartition("backup_path")
    both = (
        expected.select("manifest_no", "backup_path", one.alias("here"), none.alias("there"))
        .unionByName(there.select("manifest_no", "backup_path", none.alias("here"), one.alias("there")))
        .groupBy("manifest_no", "backup_path")
        .agg(F.sum("here").alias("here"), F.sum("there").alias("there"))
    )
    by_number = both.groupBy("manifest_no").agg(
        F.sum(F.least("here", "there")).alias("matched"),
        F.sum(F.when(F.col("there") == 0, F.col("here")).otherwise(0)).alias("missing"),
    )
    counts = by_number.join(wanted.select("manifest_no", "manifest_path"), "manifest_no").groupBy("manifest_path")
    judged = _verdicts(
        wanted.drop("manifest_no").join(any_object, [*NODE, "time_ms"], "left"), counts.agg(F.sum("matched").alias("matched"), F.sum("missing").alias("missing"))
    )
    seen = F.coalesce("n_listed", F.lit(0)) > 0
    return judged.withColumn(
        "valid", F.col("available") & seen & (F.col("files_in_manifest_only") == 0)
    ).withColumns(
        {
            "files_matched": F.when(seen, F.col("files_matched")).otherwise(0),
            "files_in_manifest_only": F.when(seen, F.col("files_in_manifest_only")).otherwise(0),
        }
    ).drop("n_listed", "time_ms")


def latest_valid_manifest(verdicts: DataFrame, span: DateRange, closed: bool = True) -> DataFrame:
    """Newest valid manifest of each node in the range (``closed`` as for v2, else half-open)."""
    moment = F.col("snapshot_ms")
    after = moment >= span.start_ms
    before = (moment <= span.end_ms) if closed else ((moment < span.end_ms) | (moment == span.start_ms))
    newest = F.max_by(F.struct("snapshot_ms", "manifest_path"), F.struct("snapshot_ms", "manifest_path"))
    return (
        verdicts.filter(after & before & F.col("valid"))
        .groupBy(*NODE)
        .agg(newest.alias("m"))
        .select(*NODE, "m.snapshot_ms", "m.manifest_path")
    )


def newest_valid_in_rounds(candidates: DataFrame, verdicts_of: Callable[[DataFrame], DataFrame], trusted: str | None = None) -> DataFrame:
    """The newest candidate of each node that holds, looked at newest first.

    ``candidates(cluster, token, snapshot_ms, manifest_path, …)``. The first round verifies
    the newest candidate of every node, the next the two after it of the nodes still without
    one, then four, and so on; a node leaves once a candidate holds, and the rounds end when no
    node has candidates left. ``verdicts_of`` verifies the manifests it is given. With
    ``trusted``, a condition over candidates, those that meet it hold without being verified,
    and a round that has one looks at nothing older.

    The candidates and each round's few rows are written below the shared folder, so a round
    starts from files. Returned are the winners with ``valid`` and ``round``.
    """
    spark = candidates.sparkSession
    newest = Window.partitionBy(*NODE).orderBy(F.desc("snapshot_ms"), F.desc("manifest_path"))
    held = F.expr(trusted) if trusted else F.lit(False)
    ranked = candidates.withColumns({"rank": F.row_number().over(newest), "trusted": F.coalesce(held, F.lit(False))})
    ranked = kept(ranked, "round-candidates")
    order = F.struct("snapshot_ms", "manifest_path")
    found, low, high, number = [], 1, 1, 0
    deepest = ranked.agg(F.max("rank")).first()[0] or 0
    open_nodes = ranked
    while low <= deepest:
        looked = open_nodes.filter(F.col("rank").between(low, high))
        asked = looked.filter(~F.col("trusted")).drop("rank", "trusted")
        if asked.isEmpty():
            judged = looked.withColumn("valid", F.lit(False))
        else:
            valid = verdicts_of(asked).filter("valid").select("manifest_path").distinct().withColumn("valid", F.lit(True))
            judged = looked.join(valid, "manifest_path", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
        row = F.struct(*candidates.columns, "valid")
        best = judged.filter("valid OR trusted").groupBy(*NODE).agg(F.max_by(row, order).alias("r")).select("r.*")
        found.append(kept(best.withColumn("round", F.lit(number)), "round-winners"))
        open_nodes = open_nodes.join(found[-1].select(*NODE), NODE, "left_anti")
        deepest = open_nodes.agg(F.max("rank")).first()[0] or 0
        low, high, number = high + 1, 2 * high + 1, number + 1
    empty = spark.createDataFrame([], ranked.drop("rank", "trusted").withColumns({"valid": F.lit(True), "round": F.lit(0)}).schema)
    return reduce(DataFrame.unionByName, found, empty)


def _checked_runs(
    status: DataFrame, verdicts: DataFrame, version: int, span: DateRange
) -> DataFrame:
    valid = verdicts.select(F.col("manifest_path").alias("location"), F.col("valid"))
    runs = finished_runs(status, version, span).join(valid, "location", "left")
    return runs.withColumn("valid", F.coalesce("valid", F.lit(False)))


def verify_latest_backup(
    status: DataFrame, verdicts: DataFrame, version: int, span: DateRange, force: bool = False
) -> DataFrame:
    """Newest finished run per node that is complete now or, unless forced, was found so before."""
    trusted = F.lit(False) if force else F.col("last_validated_ms").isNotNull()
    runs = _checked_runs(status, verdicts, version, span).filter(trusted | F.col("valid"))
    row = F.struct("start_ms", "location", "last_validated_ms", "valid")
    return (
        runs.groupBy(*NODE)
        .agg(F.max_by(row, F.struct("start_ms", "location")).alias("r"))
        .select(*NODE, "r.*")
    )


def verify_backups_in_range(
    status: DataFrame, verdicts: DataFrame, version: int, span: DateRange
) -> DataFrame:
    """Every finished run that was validated before or is complete now."""
    runs = _checked_runs(status, verdicts, version, span)
    return runs.filter(F.col("last_validated_ms").isNotNull() | F.col("valid")).withColumn(
        "newly_validated", F.col("last_validated_ms").isNull()
    )


def validation_events(verified: DataFrame, as_of_ms: int, seq: int) -> DataFrame:
    """Run events that record the validation of the newly validated runs of ``verify_backups_in_range``.

    Folded with the events before them (``seq`` must be above theirs) they date the run's
    validation and change nothing else, so a later verification trusts the run.
    """
    new = verified.filter("newly_validated")
    return new.select(
        *NODE, "version", "start_ms", F.lit(as_of_ms).alias("event_ms"), F.lit(seq).cast("bigint").alias("seq"),
        "status", "completed_ms", "snapshot_ok", "location", F.lit(as_of_ms).alias("last_validated_ms"),
    )


def slo_breaches(
    nodes: DataFrame,
    status: DataFrame,
    verdicts: DataFrame,
    version: int,
    as_of_ms: int,
    slo_hours: int = SLO_HOURS,
) -> DataFrame:
    """Per node: verified runs inside the window, how many are new, and whether none is left."""
    span = DateRange(as_of_ms - slo_hours * HOUR_MS, as_of_ms)
    verified = verify_backups_in_range(status, verdicts, version, span)
    counts = verified.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("verified"), F.count_if("newly_validated").alias("to_notify")
    )
    joined = nodes.select(*NODE).distinct().join(counts, NODE, "left")
    verified_count = F.coalesce("verified", F.lit(0)).cast("bigint")
    return joined.select(
        *NODE,
        verified_count.alias("verified"),
        F.coalesce("to_notify", F.lit(0)).cast("bigint").alias("to_notify"),
        (verified_count == 0).alias("breached"),
    )


def manifests_in_catalog(catalog: DataFrame, judged: DataFrame) -> DataFrame:
    """Manifest objects of both layouts as the input of the verifications.

    ``judged(manifest_path, available)``, as ``judge_manifests`` gives it, decides which are
    available: one that nothing is known of, lost a part or could not be read is not.
    """
    v1 = (F.col("file_type") == "META") & (F.lower("file_name") == MANIFEST_V1_NAME)
    found = catalog.filter((F.col("file_type") == "META_V2") | v1)
    rows = found.select(
        *NODE,
        F.col("remote_path").alias("manifest_path"),
        F.coalesce("last_modified_ms", "time_ms").alias("snapshot_ms"),
    )
    whole = judged.groupBy("manifest_path").agg(F.min("available").alias("available"))
    return rows.join(whole, "manifest_path", "left").select(*rows.columns, F.coalesce("available", F.lit(False)).alias("available"))


def in_span(manifests: DataFrame, span: DateRange) -> DataFrame:
    """Manifests of the range, both ends included; verify these when only the range is asked for."""
    return manifests.filter(F.col("snapshot_ms").between(span.start_ms, span.end_ms))


def of_runs(manifests: DataFrame, status: DataFrame, version: int, span: DateRange, force: bool = True) -> DataFrame:
    """Manifests of the finished runs of the range; unless forced, of those not validated before."""
    runs = finished_runs(status, version, span)
    if not force:
        runs = runs.filter(F.col("last_validated_ms").isNull())
    return manifests.join(runs.select(F.col("location").alias("manifest_path")).distinct(), "manifest_path", "left_semi")
