"""Registered queries against their SQL at the smallest scale; SNAPOPS_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as registered

DATA = "/root/testdata/sf0.001"
HEADLINE = ["retention_plan", "verify_manifest_v2", "restore_plan", "closest_token", "status_fold", "build_catalog", "build_manifest_v2", "orphan_files", "snapshot_files", "latest_valid_manifest", "verify_latest_backup", "verify_latest_backup_forced", "verify_backups_in_range", "slo_breaches", "verified_notifications", "stream_metrics", "restore_plan_v1", "judge_manifests", "read_manifest_v2", "claims", "restore_to_nearest", "unrestorable", "validated_runs", "log_and_manifest_uploads", "gossip_consensus", "registry_cas_apply", "notify_sink"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()) if os.environ.get("SNAPOPS_ALL") else HEADLINE)
def test_query_matches_sql(spark, tables, name):
    frame = registered.queries()[name](spark, DATA)
    relation = tables.sql(registered.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    found = sorted(repr([r[c] for c in sorted(frame.columns)]) for r in frame.collect())
    order = [relation.columns.index(c) for c in sorted(relation.columns)]
    assert found == sorted(repr([row[i] for i in order]) for row in relation.fetchall())


def test_every_check_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_shuffled_input_gives_the_same_plan(spark):
    from snapops.operators.retention import retention_plan
    from snapops.plans import catalog_queries as Q
    from snapops.plans import stores
    from snapops.plans import tables as T

    catalog, entries, judged = Q.catalog_v2(spark, DATA), stores.entries_v2(spark, DATA), stores.judged_v2(spark, DATA)
    mixed = retention_plan(catalog.repartition(7), entries.repartition(5), judged, Q.AS_OF, 365, feature_start_ms=Q.FEATURE_START)
    plain = Q.retention_of(spark, DATA)
    assert mixed.exceptAll(plain).isEmpty() and plain.exceptAll(mixed).isEmpty()
    oldest = entries.join(Q.catalog_v2(spark, DATA).filter("file_type = 'META_V2'").selectExpr("remote_path AS manifest_path"), "manifest_path")
    kept = oldest.filter(f"snapshot_ms = {Q.AS_OF - 365 * T.DAY}").selectExpr("backup_path AS remote_path")
    assert plain.join(kept, "remote_path").isEmpty()
