"""Manifests that cannot be read, and the way from the writer back through the reader."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from snapops import session
from snapops.operators.manifests import build_manifest_v1, build_manifest_v2, judge_manifests, write_manifests
from snapops.operators.retention import retention_plan
from snapops.operators.verify import manifests_in_catalog, verify_manifest_v2
from snapops.sources import manifests as M

DAY = 86_400_000
WHOLE = (
    '{"info":{"version":1,"appName":"c","region":"r","rack":"k","backupIdentifier":["1"]},"data":[{"keyspaceName":"k","columnfamilyName":"t",'
    '"sstables":[{"prefix":"p","sstableComponents":[{"fileName":"a","backupPath":"x/a"},{"fileName":"b","backupPath":"x/b"}]}]}]}'
)


def catalog(spark, rows):
    return spark.createDataFrame(rows, "cluster string, token string, file_type string, remote_path string, file_name string, last_modified_ms bigint, time_ms bigint")


def test_documents_tell_whether_they_were_read(spark):
    given = spark.createDataFrame([("m1", "meta_v2_1.json", WHOLE), ("m2", "meta_v2_2.json", "{not json"), ("m3", "meta_v2_3.json", None), ("m4", "meta_v2_4.json", "{}")], "manifest_path string, file_name string, document string")
    assert {r.manifest_path: (r.readable, r.n_entries) for r in M.manifest_documents(given).collect()} == {"m1": (True, 2), "m2": (False, 0), "m3": (False, 0), "m4": (False, 0)}


def test_a_manifest_that_is_not_whole_is_not_valid_and_deletes_nothing(spark):
    rows = [("c", t, "META_V2", f"m{t}", "meta_v2_1.json", 100 * DAY, None) for t in "12"] + [("c", t, "SST_V2", f"old{t}", "f", 10 * DAY, None) for t in "12"]
    listing, entries = catalog(spark, rows), spark.createDataFrame([("c", t, f"m{t}", f"keep{t}") for t in "12"], "cluster string, token string, manifest_path string, backup_path string")
    judged = spark.createDataFrame([("m1", True), ("m2", False)], "manifest_path string, available boolean")
    found = manifests_in_catalog(listing, judged)
    verdicts = verify_manifest_v2(found, entries, spark.createDataFrame([("keep1",), ("keep2",)], "remote_path string"))
    assert {r.manifest_path: r.valid for r in verdicts.collect()} == {"m1": True, "m2": False}
    plan = retention_plan(listing, entries, judged, 101 * DAY, 30, feature_start_ms=0)
    assert [r.remote_path for r in plan.collect()] == ["old1"]
    assert manifests_in_catalog(listing, judged.filter("manifest_path = 'm1'")).filter("available").count() == 1


FILES = "cluster string, token string, snapshot_ms bigint, region string, rack string, keyspace string, column_family string, file_name string, last_modified_ms bigint, creation_ms bigint, size bigint, compression string, encryption string, backup_path string"


def test_a_lost_or_broken_part_makes_its_manifest_unavailable(spark, tmp_path):
    files = spark.createDataFrame(
        [("c", token, 60_000, "r", "k", "ks", table, f"nb-{i}-Data.db", 5, 5, 9, "LZ4", "PLAINTEXT", f"{token}/{table}/{i}") for token in "1234" for table in ("t", "u") for i in range(12)], FILES
    )
    snapshots = spark.createDataFrame([("c", t, 60_000, f"m{t}") for t in "12345"], "cluster string, token string, snapshot_ms bigint, manifest_path string")
    nothing = spark.createDataFrame([], "remote_path string")
    write_manifests(build_manifest_v2(files, nothing, sstables_per_part=3), snapshots, str(tmp_path / "v2"))
    parts, record = M.read_parts(spark, str(tmp_path / "v2")), M.read_record(spark, str(tmp_path / "v2"))
    assert all(r.available and r.files_read == r.files_written == (0 if r.token == "5" else 24) for r in judge_manifests(parts, record).collect())

    some = parts.filter("keyspace = 'ks' AND column_family = 'u'").groupBy("token").agg(F.min("part_no").alias("hit"))
    hurt = parts.join(some, "token").withColumn("hit", (F.col("hit") == F.col("part_no")) & (F.col("column_family") == "u"))
    left = hurt.filter("NOT (hit AND token = '1')").withColumn("document", F.expr("if(hit AND token = '2', left(document, 40), document)"))
    short = F.expr("if(hit AND token = '3', regexp_replace(document, '\\\\{\"prefix\".*', ']}]}'), document)")
    left = left.withColumn("document", short).select(*parts.columns)
    left = left.unionByName(left.filter("token = '4'"))  # the same parts found twice
    assert {r.token: r.available for r in judge_manifests(left, record).collect()} == {"1": False, "2": False, "3": False, "4": True, "5": True}
    assert judge_manifests(parts, record.filter("token = '1'")).count() == 1

    write_manifests(build_manifest_v1(files, 5), snapshots, str(tmp_path / "v1"))
    parts, record = M.read_parts(spark, str(tmp_path / "v1")), M.read_record(spark, str(tmp_path / "v1"))
    lost = parts.filter("token = '1'").agg(F.min("part_no")).first()[0]
    kept = parts.filter(f"NOT (token = '1' AND part_no = {lost})")
    assert {r.token: r.available for r in judge_manifests(kept, record).collect()} == {"1": False, "2": True, "3": True, "4": True, "5": True}


def test_written_manifests_are_read_back(spark, tmp_path):
    files = spark.createDataFrame([("c", "1", 60_000, "r", "k", "ks", "t", f"nb-{i}-Data.db", 5, 5, 9, "LZ4", "PLAINTEXT", f"x/{i}") for i in range(30)], FILES)
    snapshots = spark.createDataFrame([("c", "1", 60_000, "m")], "cluster string, token string, snapshot_ms bigint, manifest_path string")
    write_manifests(build_manifest_v2(files, spark.createDataFrame([("x/7",)], "remote_path string"), 4), snapshots, str(tmp_path / "out"))
    parts = M.read_parts(spark, str(tmp_path / "out"))
    assert parts.count() > 1
    back = M.read_manifest_v2(parts.select("file_name", "document"))
    assert {(r.backup_path, r.is_uploaded) for r in back.collect()} == {(f"x/{i}", i == 7) for i in range(30)}


def test_files_are_read_once_to_build_a_manifest(spark):
    files = spark.createDataFrame([("c", "1", 60_000, "r", "k", "ks", "t", f"nb-{i}-Data.db", 5, 5, 9, "LZ4", "PLAINTEXT", f"x/{i}") for i in range(30)], FILES)
    built = build_manifest_v2(files, spark.createDataFrame([("x/7",)], "remote_path string"), 4)
    built.collect()
    assert "ReusedExchange" in built._jdf.queryExecution().executedPlan().toString()


def test_other_masters_must_name_the_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Cluster:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster(), "x")
    assert SparkSession.getActiveSession() is not None


def test_files_added_between_two_calls_are_read(spark, tmp_path):
    import __spark_entry__ as registered

    folder = tmp_path / "orders.parquet"
    one = spark.sql("SELECT 1L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice, timestamp_ntz'2000-01-01 00:00:00' AS o_orderdate, '1-X' AS o_orderpriority")
    query = registered.queries()["status_fold"]
    one.write.parquet(str(folder))
    before = query(spark, str(tmp_path)).count()
    one.selectExpr("2L AS o_orderkey", "3L AS o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.mode("append").parquet(str(folder))
    assert query(spark, str(tmp_path)).count() > before
