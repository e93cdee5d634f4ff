"""Queries over listings, manifests, retention and restore."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.operators import catalog as C
from snapops.operators import filters, manifests, restore, retention, verify
from snapops.operators import status as S
from snapops.plans import stores
from snapops.plans import tables as T
from snapops.plans.registry import query
from snapops.plans.stores import V1_PER_PART, V2_PER_PART, catalog_v1, catalog_v2
from snapops.plans.tables import sql_day, sql_minute
from snapops.ranges import DateRange
from snapops.session import shared_dir
from snapops.sources import listing as L
from snapops.sources import manifests as M

AS_OF = 978_307_200_000  # 2001-01-01
SPAN = DateRange(852_076_800_000, 883_612_800_000)  # 1997 to 1998, both midnights
PATH = ["cluster", "token", "file_type", "remote_path"]
FEATURE_START = 631_152_000_000  # 1990-01-01, before every date of the tables


def catalog_of(listing: DataFrame) -> DataFrame:
    return C.valid_rows(C.build_catalog(listing))


def manifests_v2(spark: SparkSession, sf: str) -> DataFrame:
    return verify.manifests_in_catalog(catalog_v2(spark, sf), stores.judged_v2(spark, sf))


def manifests_v1(spark: SparkSession, sf: str) -> DataFrame:
    return verify.manifests_in_catalog(catalog_v1(spark, sf), stores.judged_v1(spark, sf))


def objects_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Every object the catalog lists."""
    return catalog_v2(spark, sf).select("remote_path")


def span_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on the manifests of the span, whose entries are pruned by snapshot time."""
    found, entries = (verify.in_span(rows, SPAN) for rows in (manifests_v2(spark, sf), stores.entries_v2(spark, sf)))
    return verify.verify_manifest_v2(found, entries, objects_v2(spark, sf))


def span_entries(spark: SparkSession, sf: str, span: DateRange) -> Callable[[DataFrame], DataFrame]:
    """Entries of the manifests it is given, of the span only."""
    of = stores.entries_asked_v2(spark, sf)
    return lambda asked: verify.in_span(of(asked), span)


def run_verdicts(spark: SparkSession, sf: str, span: DateRange, force: bool = True) -> DataFrame:
    """Verdicts on the manifests the runs of a span wrote; unless forced, of the runs not validated before."""
    found = verify.of_runs(manifests_v2(spark, sf), run_records(spark, sf), 2, span, force)
    return verify.verify_manifest_v2(found, stores.entries_asked_v2(spark, sf), objects_v2(spark, sf), asked=True)


@T.shared_plan
def run_records(spark: SparkSession, sf: str) -> DataFrame:
    return S.status_fold(T.status_events(spark, sf))


@query(
    "scan_listing",
    "lst clusters",
    "SELECT path AS remote_path, size, last_modified_ms AS modified_ms FROM lst JOIN clusters USING (cluster) "
    "WHERE path LIKE 'backup/' || (SELECT hashed FROM clusters WHERE cluster = 'app1') || '/3/SST_V2/%' "
    "AND path > 'backup/' || (SELECT hashed FROM clusters WHERE cluster = 'app1') || '/3/SST_V2/9'",
)
def scan_listing(spark, sf):
    prefix = "backup/880_app1/3/SST_V2/"
    return L.scan_listing(stores.listing_v2(spark, sf), prefix, prefix + "9")


@query(
    "list_token_prefixes",
    "v1",
    "SELECT DISTINCT 'backup' AS base_dir, 'us-east-1' AS region, cluster, token FROM v1 WHERE cluster = 'app1'",
)
def list_token_prefixes(spark, sf):
    return C.token_prefixes(T.listing_v1(spark, sf), "backup/us-east-1/app1/")


@query(
    "build_catalog",
    "v1 v2",
    """SELECT remote_path, 'us-east-1' AS region, cluster, token, file_type, keyspace, column_family, file_name, time_ms,
        NULL::BIGINT AS last_modified_ms, NULL AS compression, FALSE AS is_v2, file_type IN ('SNAP', 'SST') AS is_data,
        CASE WHEN file_type = 'CL' THEN '/commitlog/' || file_name WHEN file_type = 'META' THEN '/data/' || file_name
        ELSE '/data/' || keyspace || '/' || column_family || '/' || file_name END AS target FROM v1
    UNION ALL SELECT remote_path, NULL, cluster, token, file_type, keyspace, column_family, file_name, NULL,
        last_modified_ms, 'SNAPPY', TRUE, file_type = 'SST_V2', CASE WHEN file_type = 'META_V2' THEN '/data/' || file_name
        ELSE '/data/' || keyspace || '/' || column_family || '/' || file_name END FROM v2""",
)
def build_catalog(spark, sf):
    rows = catalog_of(T.listing_all(spark, sf)).withColumn("target", C.restore_target("/data", "/commitlog"))
    return rows.select(
        "remote_path", "region", "cluster", "token", "file_type", "keyspace", "column_family", "file_name",
        "time_ms", "last_modified_ms", "compression", "is_v2", "is_data", "target",
    )


@query(
    "rejected_paths",
    "obj",
    """SELECT 'backup/1_' || substr(path, 8) AS remote_path, 'bad_cluster_hash' AS error FROM obj
    UNION ALL SELECT 'backup/us-east-1/app0/' || o_orderkey || '/file', 'too_few_parts' FROM orders""",
)
def rejected_paths(spark, sf):
    return C.rejected_rows(C.build_catalog(T.listing_all(spark, sf)))


@query(
    "reencode_catalog",
    "v1 v2",
    "SELECT remote_path, remote_path AS encoded_path, TRUE AS round_trips FROM v1 "
    "UNION ALL SELECT remote_path, remote_path, TRUE FROM v2",
)
def reencode_catalog(spark, sf):
    rows = C.reencode_catalog(catalog_of(T.listing_all(spark, sf)))
    return rows.select("remote_path", "encoded_path", "round_trips")


@query(
    "migrate_to_v2",
    "v1 clusters",
    """SELECT remote_path AS v1_path, 'backup/' || hashed || '/' || token || '/' ||
        CASE WHEN file_type = 'META' THEN 'META_V2/' || time_ms || '/SNAPPY/PLAINTEXT/' || file_name
        ELSE 'SST_V2/' || time_ms || '/' || keyspace || '/' || column_family || '/SNAPPY/PLAINTEXT/' || file_name END AS v2_path
        FROM v1 JOIN clusters USING (cluster) WHERE file_type <> 'CL'""",
)
def migrate_to_v2(spark, sf):
    return C.migrate_to_v2(catalog_v1(spark, sf))


@query(
    "filter_keyspace_table",
    "obj",
    """SELECT path AS remote_path FROM obj WHERE NOT (keyspace = 'ks2' OR (keyspace = 'ks3' AND column_family = 'cf4'))
        AND (keyspace IN ('ks1', 'ks2', 'ks3') OR (keyspace = 'ks5' AND column_family IN ('cf1', 'cf7')))""",
)
def filter_keyspace_table(spark, sf):
    rows = T.objects(spark, sf)
    kept = filters.filter_keyspace_table(rows, "ks1.*,ks2.*,ks3.*,ks5.cf1,ks5.cf7-0a1b", "ks2.*,ks3.cf4")
    return kept.select(F.col("path").alias("remote_path"))


OPEN = f"(time_ms = {SPAN.start_ms} OR (time_ms > {SPAN.start_ms} AND time_ms < {SPAN.end_ms}))"


@query("list_v1_range", "v1", f"SELECT cluster, token, file_type, remote_path FROM v1 WHERE {OPEN}")
def list_v1_range(spark, sf):
    return filters.list_v1_range(catalog_v1(spark, sf), SPAN).select(*PATH)


@query(
    "list_by_type",
    "v1",
    f"""SELECT cluster, token, remote_path, '{{"bucket":"store","filename":"' || remote_path || '","app":"' || cluster ||
        '","region":"us-east-1","token":"' || token || '","ts":"' || {sql_minute('time_ms')} || '"}}' AS file_json,
        count(*) OVER (PARTITION BY cluster, token) AS num_files FROM v1 WHERE file_type = 'SST' AND {OPEN}""",
)
def list_by_type(spark, sf):
    return filters.list_by_type(catalog_v1(spark, sf), SPAN, "SST", "store")


@query(
    "list_manifests_by_type",
    "v1",
    f"""SELECT cluster, token, remote_path, count(*) OVER (PARTITION BY cluster, token) AS num_files
        FROM v1 WHERE file_type = 'META' AND {OPEN}""",
)
def list_manifests_by_type(spark, sf):
    return filters.list_by_type(catalog_v1(spark, sf), SPAN, "META", "store").drop("file_json")


@query(
    "find_manifests_v2",
    "man",
    f"SELECT cluster, token, manifest_path AS remote_path FROM man WHERE snapshot_ms BETWEEN {SPAN.start_ms} AND {SPAN.end_ms}",
)
def find_manifests_v2(spark, sf):
    return filters.find_manifests_v2(catalog_v2(spark, sf), SPAN).select("cluster", "token", "remote_path")


@query(
    "find_manifests_v1",
    "v1",
    f"SELECT cluster, token, remote_path FROM v1 WHERE file_type = 'META' AND {OPEN}",
)
def find_manifests_v1(spark, sf):
    return filters.find_manifests_v1(catalog_v1(spark, sf), SPAN).select("cluster", "token", "remote_path")


@query(
    "incrementals_v2",
    "v2",
    f"SELECT cluster, token, remote_path FROM v2 WHERE file_type = 'SST_V2' AND last_modified_ms BETWEEN {SPAN.start_ms} AND {SPAN.end_ms}",
)
def incrementals_v2(spark, sf):
    return filters.incrementals_v2(catalog_v2(spark, sf), SPAN).select("cluster", "token", "remote_path")


@query("incrementals_v1", "v1", f"SELECT cluster, token, remote_path FROM v1 WHERE file_type = 'SST' AND {OPEN}")
def incrementals_v1(spark, sf):
    return filters.incrementals_v1(catalog_v1(spark, sf), SPAN).select("cluster", "token", "remote_path")


# --- manifests ------------------------------------------------------------------------------


@query(
    "build_manifest_v1",
    "ent",
    f"""SELECT cluster, token, snapshot_ms, ('0x' || substr(md5(path_v1), 1, 7))::BIGINT % n_parts AS part_no,
        '["' || string_agg(path_v1, '","' ORDER BY path_v1) || '"]' AS document, count(*) AS n_files
        FROM ent JOIN (SELECT cluster, token, snapshot_ms, ceil(count(*) / {V1_PER_PART}.0)::BIGINT AS n_parts FROM ent GROUP BY 1, 2, 3)
        USING (cluster, token, snapshot_ms) GROUP BY 1, 2, 3, 4""",
)
def build_manifest_v1(spark, sf):
    return manifests.build_manifest_v1(T.entries_v1(spark, sf), V1_PER_PART)


COMPONENT = """'{"fileName":"' || file_name || '","lastModifiedTime":' || last_modified_ms || ',"fileCreationTime":' || last_modified_ms
    || ',"fileSizeOnDisk":' || size || ',"compression":"SNAPPY","encryption":"PLAINTEXT","isUploaded":'
    || (min_orderkey % 4001 <> 0)::VARCHAR || ',"backupPath":"' || backup_path || '"}'"""
PREFIX = "regexp_extract(file_name, '^(.*)-[^-]*$', 1)"


@query(
    "build_manifest_v2",
    "ent",
    f"""SELECT cluster, token, snapshot_ms, keyspace, column_family, part_no, 'meta_v2_' || {sql_minute('snapshot_ms')} || '.json' AS file_name,
        '{{"info":{{"version":1,"appName":"' || cluster || '","region":"us-east-1","rack":"r1","backupIdentifier":["' || token ||
        '"]}},"data":[{{"keyspaceName":"' || keyspace || '","columnfamilyName":"' || column_family || '","sstables":[' ||
        string_agg('{{"prefix":"' || prefix || '","sstableComponents":[' || components || ']}}', ',' ORDER BY prefix) || ']}}]}}' AS document, sum(n_components)::BIGINT AS n_files
        FROM (SELECT s.*, ('0x' || substr(md5(prefix), 1, 7))::BIGINT % ceil(count(*) OVER
            (PARTITION BY cluster, token, snapshot_ms, keyspace, column_family) / {V2_PER_PART}.0)::BIGINT AS part_no
            FROM (SELECT cluster, token, snapshot_ms, keyspace, column_family, {PREFIX} AS prefix,
                string_agg({COMPONENT}, ',' ORDER BY file_name, last_modified_ms, size) AS components, count(*) AS n_components FROM ent GROUP BY 1, 2, 3, 4, 5, 6) s)
        GROUP BY 1, 2, 3, 4, 5, 6""",
)
def build_manifest_v2(spark, sf):
    return manifests.build_manifest_v2(T.entries(spark, sf), T.listing_v2(spark, sf), V2_PER_PART)


@query(
    "judge_manifests",
    "judged",
    """SELECT cluster, token, snapshot_ms, manifest_path, files_written, files_read, files_read = files_written AS available FROM judged""",
)
def judge_manifests(spark, sf):
    """Manifests written, damaged, read back and held against their record."""
    return stores.judged_v2(spark, sf).drop("parts_written", "parts_read")


@query(
    "read_manifest_v2",
    "ent_read",
    f"""SELECT snapshot_ms, cluster, token, keyspace, column_family, {PREFIX} AS prefix, file_name, last_modified_ms, size, 
        min_orderkey % 4001 <> 0 AS is_uploaded, backup_path FROM ent_read""",
)
def read_manifest_v2(spark, sf):
    documents = stores.parts_v2(spark, sf).select("snapshot_ms", "file_name", "document")
    return M.read_manifest_v2(documents).drop("creation_ms", "compression", "encryption")


@query("read_manifest_v1", "ent", "SELECT cluster, token, snapshot_ms, path_v1 AS backup_path FROM ent")
def read_manifest_v1(spark, sf):
    return stores.entries_v1(spark, sf).select("cluster", "token", "snapshot_ms", "backup_path")


LATEST = f"""(SELECT cluster, token, max(snapshot_ms) AS snapshot_ms, arg_max(manifest_path, snapshot_ms) AS manifest_path FROM verdict
    WHERE valid AND snapshot_ms BETWEEN {SPAN.start_ms} AND {SPAN.end_ms} GROUP BY 1, 2)"""


@query(
    "snapshot_files",
    "verdict",
    f"""WITH latest AS MATERIALIZED (SELECT manifest_path FROM {LATEST})
        SELECT e.cluster, e.token, 'SST_V2' AS file_type, backup_path AS remote_path, keyspace, column_family, last_modified_ms
        FROM ent_read e WHERE manifest_path IN (SELECT manifest_path FROM latest)""",
)
def snapshot_files(spark, sf):
    latest = verify.latest_valid_manifest(span_verdicts(spark, sf), SPAN)
    paths = manifests.snapshot_paths(span_entries(spark, sf, SPAN), latest)
    return catalog_of(paths).select(*PATH, "keyspace", "column_family", "last_modified_ms")


# --- verification ---------------------------------------------------------------------------


@query(
    "verify_manifest_v2",
    "verdict",
    "SELECT cluster, token, snapshot_ms, manifest_path, available, files_matched, files_in_manifest_only, valid FROM verdict",
)
def verify_manifest_v2(spark, sf):
    return verify.verify_manifest_v2(manifests_v2(spark, sf), stores.entries_v2(spark, sf), objects_v2(spark, sf))


@query(
    "missing_files",
    "ent_read",
    "SELECT manifest_path, backup_path FROM ent_read WHERE min_orderkey % 4001 = 0",
)
def missing_files(spark, sf):
    return verify.missing_files(stores.entries_v2(spark, sf), objects_v2(spark, sf))


@query(
    "verify_manifest_v1",
    "man ent",
    """SELECT m.cluster, m.token, m.snapshot_ms, manifest_v1 AS manifest_path,
        count(path_v1) FILTER (path_v1 IN (SELECT path_v1 FROM ent WHERE min_orderkey % 4001 <> 0)) AS files_matched,
        count(path_v1) FILTER (path_v1 NOT IN (SELECT path_v1 FROM ent WHERE min_orderkey % 4001 <> 0)) AS files_in_manifest_only,
        count(path_v1) FILTER (path_v1 NOT IN (SELECT path_v1 FROM ent WHERE min_orderkey % 4001 <> 0)) = 0 AS valid
        FROM man m LEFT JOIN (SELECT DISTINCT cluster, token, snapshot_ms, path_v1 FROM ent) e
        ON m.cluster = e.cluster AND m.token = e.token AND m.snapshot_ms = e.snapshot_ms GROUP BY 1, 2, 3, 4""",
)
def verify_manifest_v1(spark, sf):
    once = stores.entries_v1(spark, sf).repartition("backup_path").dropDuplicates(["manifest_path", "backup_path"])
    return verify.verify_manifest_v1(manifests_v1(spark, sf), once, catalog_v1(spark, sf)).drop("available")


def verdicts_of(spark: SparkSession, sf: str, span: DateRange):
    """Verification of the manifests it is given, over the entries of the span only."""
    entries = span_entries(spark, sf, span)
    return lambda asked: verify.verify_manifest_v2(asked, entries, objects_v2(spark, sf), asked=True)


@query("latest_valid_manifest", "verdict", f"SELECT * FROM {LATEST}")
def latest_valid_manifest(spark, sf):
    candidates = verify.in_span(manifests_v2(spark, sf), SPAN)
    latest = verify.newest_valid_in_rounds(candidates, verdicts_of(spark, sf, SPAN))
    return latest.select("cluster", "token", "snapshot_ms", "manifest_path")


FINISHED = f"SELECT * FROM run WHERE status = 'FINISHED' AND version = 2 AND start_ms BETWEEN {SPAN.start_ms} AND {SPAN.end_ms}"


@query("latest_backup_metadata", "run", FINISHED)
def latest_backup_metadata(spark, sf):
    return S.latest_backup_metadata(run_records(spark, sf), 2, SPAN)


CHECKED = f"""(SELECT r.*, v.valid FROM ({FINISHED}) r JOIN verdict v ON r.location = v.manifest_path)"""


@query(
    "verify_latest_backup",
    "run verdict",
    f"""SELECT cluster, token, max(start_ms) AS start_ms, arg_max(location, start_ms) AS location,
        (arg_max({{'v': last_validated_ms}}, start_ms)).v AS last_validated_ms
        FROM {CHECKED} WHERE valid OR last_validated_ms IS NOT NULL GROUP BY 1, 2""",
)
def verify_latest_backup(spark, sf):
    """Newest run first: a run validated before ends the search of its node without a look at its files."""
    runs = S.latest_backup_metadata(run_records(spark, sf), 2, SPAN)
    known = manifests_v2(spark, sf).select(F.col("manifest_path").alias("location"), "available")
    candidates = runs.join(known, "location").select(
        "cluster", "token", F.col("start_ms").alias("snapshot_ms"), F.col("location").alias("manifest_path"), "available", "last_validated_ms"
    )
    every = stores.entries_asked_v2(spark, sf)
    verify_asked = lambda asked: verify.verify_manifest_v2(asked.dropDuplicates(["manifest_path"]), every, objects_v2(spark, sf), asked=True)
    latest = verify.newest_valid_in_rounds(candidates, verify_asked, "last_validated_ms IS NOT NULL")
    return latest.select("cluster", "token", F.col("snapshot_ms").alias("start_ms"), F.col("manifest_path").alias("location"), "last_validated_ms")


@query(
    "verify_latest_backup_forced",
    "run verdict",
    f"""SELECT cluster, token, max(start_ms) AS start_ms, arg_max(location, start_ms) AS location
        FROM {CHECKED} WHERE valid GROUP BY 1, 2""",
)
def verify_latest_backup_forced(spark, sf):
    latest = verify.verify_latest_backup(run_records(spark, sf), run_verdicts(spark, sf, SPAN), 2, SPAN, force=True)
    return latest.select("cluster", "token", "start_ms", "location")


@query(
    "verify_backups_in_range",
    "run verdict",
    f"""SELECT cluster, token, start_ms, location, last_validated_ms IS NULL AS newly_validated
        FROM {CHECKED} WHERE valid OR last_validated_ms IS NOT NULL""",
)
def verify_backups_in_range(spark, sf):
    """Runs validated before are trusted, so only the manifests of the others are looked at."""
    found = verify.verify_backups_in_range(run_records(spark, sf), run_verdicts(spark, sf, SPAN, force=False), 2, SPAN)
    return found.select("cluster", "token", "start_ms", "location", "newly_validated")


@query(
    "validated_runs",
    "run verdict",
    f"""SELECT r.* REPLACE (CASE WHEN v.valid AND r.last_validated_ms IS NULL AND status = 'FINISHED' AND version = 2
        AND start_ms BETWEEN {SPAN.start_ms} AND {SPAN.end_ms} THEN {AS_OF} ELSE r.last_validated_ms END AS last_validated_ms)
        FROM run r LEFT JOIN verdict v ON r.location = v.manifest_path""",
)
def validated_runs(spark, sf):
    """Run records after the runs found complete were marked so by events of their own."""
    verified = verify.verify_backups_in_range(run_records(spark, sf), run_verdicts(spark, sf, SPAN, force=False), 2, SPAN)
    return S.status_fold(T.status_events(spark, sf).unionByName(verify.validation_events(verified, AS_OF, 2**40)))


SLO_AS_OF = 880_000_000_000
SLO_SPAN = DateRange(SLO_AS_OF - T.DAY, SLO_AS_OF)


@query(
    "slo_breaches",
    "run verdict",
    f"""SELECT n.cluster, n.token, count(r.start_ms) AS verified, count(r.start_ms) FILTER (last_validated_ms IS NULL) AS to_notify,
        count(r.start_ms) = 0 AS breached
        FROM (SELECT DISTINCT cluster, token FROM run) n LEFT JOIN (
            SELECT r.* FROM run r JOIN verdict v ON r.location = v.manifest_path
            WHERE status = 'FINISHED' AND version = 2 AND start_ms BETWEEN {SLO_AS_OF} - 86400000 AND {SLO_AS_OF}
            AND (v.valid OR last_validated_ms IS NOT NULL)) r
        ON n.cluster = r.cluster AND n.token = r.token GROUP BY 1, 2""",
)
def slo_breaches(spark, sf):
    records = run_records(spark, sf)
    return verify.slo_breaches(records, records, run_verdicts(spark, sf, SLO_SPAN, force=False), 2, SLO_AS_OF)


# --- run records ----------------------------------------------------------------------------


@query("status_fold", "run", "SELECT * FROM run")
def status_fold(spark, sf):
    return run_records(spark, sf)


@query(
    "status_by_day",
    "run",
    f"""SELECT cluster, token, {sql_day('day_ms')} AS day, bool_or(status = 'FINISHED' AND version = 1) AS has_finished,
        arg_max(start_ms, start_ms) FILTER (status = 'FINISHED' AND version = 1) AS start_ms,
        arg_max(completed_ms, start_ms) FILTER (status = 'FINISHED' AND version = 1) AS completed_ms,
        arg_max(location, start_ms) FILTER (status = 'FINISHED' AND version = 1) AS location
        FROM (SELECT *, start_ms // 86400000 * 86400000 AS day_ms FROM run UNION ALL
            SELECT *, start_ms - 86400000 FROM run WHERE start_ms % 86400000 = 0) GROUP BY cluster, token, day_ms""",
)
def status_by_day(spark, sf):
    return S.status_by_day(run_records(spark, sf))


@query(
    "snapshots_by_day",
    "run",
    f"SELECT cluster, token, snapshot_date, {sql_minute('start_ms')} AS started FROM run WHERE version = 1",
)
def snapshots_by_day(spark, sf):
    return S.snapshots_by_day(run_records(spark, sf))


KEPT_DAYS = """SELECT {columns} FROM run JOIN (SELECT cluster, token, snapshot_date FROM (
    SELECT cluster, token, snapshot_date, row_number() OVER (PARTITION BY cluster, token ORDER BY min(start_ms) DESC, snapshot_date DESC) AS rn
    FROM run GROUP BY 1, 2, 3) WHERE rn <= 60) USING (cluster, token, snapshot_date)"""


@query("keep_last_days", "run", KEPT_DAYS.format(columns="cluster, token, version, start_ms, snapshot_date"))
def keep_last_days(spark, sf):
    kept = S.keep_last_days(run_records(spark, sf), "start_ms")
    return kept.select("cluster", "token", "version", "start_ms", "snapshot_date")


@query("status_store", "run", KEPT_DAYS.format(columns="run.*"))
def status_store(spark, sf):
    """The days a store keeps, written by day and read back."""
    path = shared_dir(spark, "status")
    S.save_status(S.keep_last_days(run_records(spark, sf), "start_ms"), path)
    return S.load_status(spark, path)


# --- retention ------------------------------------------------------------------------------


@T.shared_plan
def retention_of(spark: SparkSession, sf: str) -> DataFrame:
    return retention.retention_plan(
        catalog_v2(spark, sf), stores.entries_asked_v2(spark, sf), stores.judged_v2(spark, sf), AS_OF, retention_days=365, feature_start_ms=FEATURE_START
    )


_T = AS_OF - 365 * T.DAY


@query(
    "retention_plan",
    "v2 verdict",
    f"""WITH oldest AS MATERIALIZED (SELECT cluster, token, min(snapshot_ms) AS snapshot_ms FROM man WHERE snapshot_ms BETWEEN {_T} AND {AS_OF} GROUP BY 1, 2),
        keep AS MATERIALIZED (SELECT cluster, token, backup_path FROM ent_read JOIN oldest USING (cluster, token, snapshot_ms)
            WHERE manifest_path IN (SELECT manifest_path FROM judged WHERE files_read = files_written)),
        gone AS MATERIALIZED (SELECT cluster, token, file_type, remote_path, last_modified_ms FROM v2
            WHERE file_type = 'SST_V2' AND last_modified_ms <= {_T} - 5 * {T.DAY}),
        old AS MATERIALIZED (SELECT cluster, token, file_type, remote_path, last_modified_ms FROM v2
            WHERE file_type = 'META_V2' AND last_modified_ms BETWEEN {FEATURE_START} AND {_T} - 3600000),
        kept AS MATERIALIZED (SELECT DISTINCT backup_path AS remote_path FROM keep), guard AS MATERIALIZED (SELECT DISTINCT cluster, token FROM keep)
        SELECT x.cluster, x.token, file_type, remote_path, last_modified_ms
        FROM (SELECT * FROM old UNION ALL SELECT gone.* FROM gone ANTI JOIN kept USING (remote_path)) x SEMI JOIN guard USING (cluster, token)""",
)
def retention_plan(spark, sf):
    return retention_of(spark, sf)


@query(
    "lifecycle_rule_plan",
    "",
    """SELECT p.prefix, p.retention_days, CASE WHEN p.retention_days <= 0 AND r.days IS NOT NULL THEN 'REMOVE' WHEN p.retention_days <= 0 THEN 'NONE'
        WHEN r.days IS NULL THEN 'ADD' WHEN r.days = p.retention_days AND r.enabled THEN 'NONE' ELSE 'UPDATE' END AS action
        FROM (SELECT c_name AS prefix, (c_custkey % 4) * 10 AS retention_days FROM customer) p LEFT JOIN
        (SELECT s, arg_min(days, k) AS days, arg_min(enabled, k) AS enabled FROM (SELECT 'customer#' || substr(s_name, 10) AS s, s_suppkey AS k,
            (s_suppkey % 3 + 1) * 10 AS days, s_suppkey % 5 <> 0 AS enabled FROM supplier) GROUP BY 1) r ON lower(p.prefix) = r.s""",
)
def lifecycle_rule_plan(spark, sf):
    prefixes = T.table(spark, sf, "customer").select(
        F.col("c_name").alias("prefix"), ((F.col("c_custkey") % 4) * 10).alias("retention_days")
    )
    key = F.col("s_suppkey")
    rules = T.table(spark, sf, "supplier").select(
        key.alias("rule_no"),
        F.concat(F.lit("CUSTOMER#"), F.expr("substr(s_name, 10)")).alias("prefix"),
        ((key % 3 + 1) * 10).alias("expiration_days"),
        F.when(key % 5 == 0, "Disabled").otherwise("Enabled").alias("status"),
    )
    return retention.lifecycle_rule_plan(prefixes, rules)


# --- restore --------------------------------------------------------------------------------


RESTORE = f"""SELECT cluster, token, origin, 'SST_V2' AS file_type, keyspace, column_family, remote_path,
        '/data/' || keyspace || '/' || column_family || '/' || file_name AS target FROM (
        SELECT e.cluster, e.token, 'snapshot' AS origin, keyspace, column_family, backup_path AS remote_path, file_name
            FROM ent_read e JOIN {LATEST} l ON e.manifest_path = l.manifest_path
        UNION ALL SELECT v.cluster, v.token, 'incremental', keyspace, column_family, remote_path, file_name
            FROM v2 v JOIN {LATEST} l ON v.cluster = l.cluster AND v.token = l.token AND v.last_modified_ms BETWEEN l.snapshot_ms AND {SPAN.end_ms}
            WHERE file_type = 'SST_V2') WHERE keyspace <> 'ks6'"""


@T.shared_plan
def restore_of(spark: SparkSession, sf: str) -> DataFrame:
    return restore.restore_plan(
        catalog_v2(spark, sf), span_entries(spark, sf, SPAN), span_verdicts(spark, sf), SPAN, exclude="ks6.*"
    )


@query("restore_plan", "verdict v2", RESTORE)
def restore_plan(spark, sf):
    return restore_of(spark, sf)


@query(
    "restore_to_nearest",
    "verdict v2",
    f"""WITH plan AS MATERIALIZED ({RESTORE}),
        w AS (SELECT DISTINCT 'app' || (c_custkey % 2) AS cluster, c_custkey % 37 AS t FROM customer),
        b AS MATERIALIZED (SELECT DISTINCT cluster, token::BIGINT AS t FROM v2),
        s AS (SELECT w.cluster, w.t::VARCHAR AS token, b.t::VARCHAR AS source_token FROM w JOIN b USING (cluster)
            QUALIFY row_number() OVER (PARTITION BY w.cluster, w.t ORDER BY abs(w.t - b.t), b.t DESC) = 1)
        SELECT s.cluster, s.token, source_token, origin, remote_path, target FROM s JOIN plan p ON p.cluster = s.cluster AND p.token = source_token""",
)
def restore_to_nearest(spark, sf):
    """Nodes of a ring with other tokens, restored from the backed-up tokens nearest to theirs."""
    key = F.col("c_custkey")
    wanted = T.table(spark, sf, "customer").select(F.concat(F.lit("app"), T.text(key % 2)).alias("cluster"), T.text(key % 37).alias("token"))
    sources = restore.nearest_sources(wanted, catalog_v2(spark, sf))
    plan = restore.plan_from_sources(restore_of(spark, sf), sources)
    return plan.select("cluster", "token", "source_token", "origin", "remote_path", "target")


@query(
    "unrestorable",
    "verdict",
    f"""WITH latest AS MATERIALIZED (SELECT manifest_path FROM {LATEST})
        SELECT replace(backup_path, '/SNAPPY/', '/ZIP/') AS remote_path, 'unknown_compression' AS error FROM ent_read
        WHERE keyspace = 'ks5' AND file_name LIKE '%-Index.db' AND manifest_path IN (SELECT manifest_path FROM latest)""",
)
def unrestorable(spark, sf):
    """Paths of the chosen manifests that name a codec nobody knows."""
    entries = span_entries(spark, sf, SPAN)
    odd = (F.col("keyspace") == "ks5") & F.col("file_name").endswith("-Index.db")
    written = F.when(odd, F.replace("backup_path", F.lit("/SNAPPY/"), F.lit("/ZIP/"))).otherwise(F.col("backup_path"))
    return restore.unrestorable(lambda asked: entries(asked).withColumn("backup_path", written), span_verdicts(spark, sf), SPAN)


@query(
    "restore_plan_v1",
    "man ent v1",
    f"""WITH ok AS (SELECT cluster, token, max(snapshot_ms) AS snapshot_ms FROM man m WHERE snapshot_ms >= {SPAN.start_ms} AND snapshot_ms < {SPAN.end_ms}
            AND manifest_v1 NOT IN (SELECT manifest_v1 FROM ent GROUP BY manifest_v1, path_v1 HAVING bool_and(min_orderkey % 4001 = 0)) GROUP BY 1, 2)
        SELECT cluster, token, 'snapshot' AS origin, path_v1 AS remote_path FROM ent JOIN ok USING (cluster, token, snapshot_ms)
        UNION ALL SELECT cluster, token, 'incremental', remote_path FROM v1 JOIN ok USING (cluster, token)
            WHERE file_type = 'SST' AND time_ms >= snapshot_ms AND time_ms < {SPAN.end_ms}
        UNION ALL SELECT cluster, token, 'commitlog', remote_path FROM (SELECT v1.*, row_number() OVER (PARTITION BY cluster, token ORDER BY remote_path DESC) AS rn
            FROM v1 JOIN ok USING (cluster, token) WHERE file_type = 'CL' AND time_ms >= snapshot_ms AND time_ms < {SPAN.end_ms}) WHERE rn <= 10""",
)
def restore_plan_v1(spark, sf):
    catalog = catalog_v1(spark, sf)
    listed = stores.entries_v1(spark, sf)
    judged = verify.verify_manifest_v1(manifests_v1(spark, sf), listed, catalog)
    plan = restore.restore_plan(catalog, listed, judged, SPAN, commit_logs=10, v2=False)
    return plan.select("cluster", "token", "origin", "remote_path")


@query(
    "last_n_commitlogs",
    "v1",
    """SELECT cluster, token, remote_path FROM (SELECT *, row_number() OVER (PARTITION BY cluster, token ORDER BY remote_path DESC) AS rn
        FROM v1 WHERE file_type = 'CL') WHERE rn <= 10""",
)
def last_n_commitlogs(spark, sf):
    return restore.last_n_commitlogs(catalog_v1(spark, sf)).select("cluster", "token", "remote_path")


@query(
    "keep_largest_n",
    "",
    """SELECT 'app' || (o_custkey % 2) AS cluster, o_orderdate::VARCHAR AS day FROM orders GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY day DESC) <= 20""",
)
def keep_largest_n(spark, sf):
    days = T.table(spark, sf, "orders").select(
        F.concat(F.lit("app"), (F.col("o_custkey") % 2).cast("string")).alias("cluster"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("day"),
    )
    return restore.keep_largest_n(days, "day", 20, ["cluster"])
