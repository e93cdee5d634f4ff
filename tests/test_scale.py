"""What the larger tables need: files that stay where they are, few rows written down, packed sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snapops.operators import catalog as C
from snapops.operators import filters, manifests, notify, verify
from snapops.plans import stores
from snapops.plans import tables as T
from snapops.ranges import DateRange
from snapops.schemas import LISTING
from snapops.session import FIRST_PARTITIONS, INPUT_PER_PARTITION, MERGED_BYTES, fit_shuffles
from snapops.sources import stored as stored_tables
from snapops.sources.manifests import read_manifest_v2


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of two nodes and their lines, some alike, one without a part."""
    path = tmp_path_factory.mktemp("tables")
    day = [datetime(1998, 1, 1 + d) for d in range(3)]
    orders = [(k, k % 4, "F", 1.0, day[k % 3], "1-X") for k in range(1, 41)]
    lines = [(k, None if k == 7 else k % 9, n, float(n + k), day[n % 3]) for k in range(1, 41) for n in (1, 2, 2, 3)]
    kinds = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
    spark.createDataFrame(orders, T.SCHEMAS["orders"]).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, kinds).write.parquet(f"{path}/lineitem.parquet")
    return str(path), lines


def test_objects_are_grouped_once_and_read_without_a_shuffle(spark, folder):
    path, lines = folder
    T.forget_plans()
    found = T.objects(spark, path)
    assert "Exchange" not in plan_of(found) and "Exchange" not in plan_of(T.manifests(spark, path))
    keys = {}
    for order, part, number, quantity, at in lines:
        kind = None if part is None else {0: "Data.db", 1: "Index.db"}.get(number % 3, "CompressionInfo.db")
        name = None if part is None else f"mc-{part}-{kind}"
        first, most = keys.get((order % 4 % 2, order % 4 % 10, at, name), (order, quantity))
        keys[(order % 4 % 2, order % 4 % 10, at, name)] = (min(first, order), max(most, quantity))
    rows = {(int(r.cluster[3:]), int(r.token), datetime(1970, 1, 1) + timedelta(milliseconds=r.last_modified_ms), r.file_name): (r.min_orderkey, r.size) for r in found.collect()}
    assert found.count() == len(rows)
    assert rows == {k: (first, (int(most) - 1) * 1024) for k, (first, most) in keys.items()}
    paths = {r.path for r in found.filter("file_name IS NOT NULL").collect()}
    assert paths == {r.p for r in found.filter("file_name IS NOT NULL").select(F.concat_ws("/", F.lit("backup"), C.hashed_cluster(F.col("cluster")), "token", F.lit("SST_V2"), "last_modified_ms", "keyspace", "column_family", F.lit("SNAPPY/PLAINTEXT"), "file_name").alias("p")).collect()}


def test_tables_derived_from_objects_shuffle_nothing(spark, folder):
    path, _ = folder
    T.forget_plans()
    for listing in (T.entries, T.listing_v1, T.listing_v2, T.listing_all):
        assert "Exchange hash" not in plan_of(listing(spark, path)) and "Exchange range" not in plan_of(listing(spark, path))
    entries = stores.entries_v2(spark, path)
    assert entries.count() > 0 and "Exchange hash" not in plan_of(entries)


@pytest.mark.parametrize("few", [0, 10])
def test_files_are_marked_alike_where_few_and_where_many_are_not_listed(spark, few):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), (None, 5)], "backup_path string, n int")
    listing = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "remote_path string")
    marked = manifests.mark_wide(files, listing, few=few)
    assert sorted((r.n, r.is_uploaded) for r in marked.collect()) == [(1, True), (2, False), (3, False), (4, False), (5, False)]
    assert marked.columns == ["backup_path", "n", "is_uploaded"]


def test_a_manifests_files_are_shuffled_once(spark):
    files = spark.range(40).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("cluster"), F.concat(F.lit("1"), F.col("id") % 2).alias("token"), (F.col("id") % 2).alias("snapshot_ms"),
        F.lit("r").alias("region"), F.lit("k").alias("rack"), F.concat(F.lit("ks"), F.col("id") % 3).alias("keyspace"), F.concat(F.lit("t"), F.col("id") % 3).alias("column_family"), F.concat(F.lit("nb-"), "id", F.lit("-Data.db")).alias("file_name"),
        F.lit(5).alias("last_modified_ms"), F.lit(5).alias("creation_ms"), F.lit(9).alias("size"), F.lit("LZ4").alias("compression"),
        F.lit("PLAINTEXT").alias("encryption"), F.concat(F.lit("x/"), "id").alias("backup_path"),
    )
    built = manifests.build_manifest_v2(files, spark.createDataFrame([("x/7",)], "remote_path string"), 4)
    assert built.agg(F.sum("n_files")).first()[0] == 40
    built.collect()
    final = built._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in final.splitlines() if "Exchange hashpartitioning" in line or "ReusedExchange" in line]
    assert len(shuffles) == 2 and sum("ReusedExchange" in line for line in shuffles) == 1


def test_a_catalog_in_order_is_written_without_a_shuffle(spark, tmp_path):
    paths = [f"store/us-east-1/alpha/1/20000101{m // 60:02d}{m % 60:02d}/{kind}/ks/t/f{m}" for m in range(300) for kind in ("SNAP", "SST")]
    catalog = C.build_catalog(spark.createDataFrame([(p, 1, None) for p in paths], LISTING))
    before = spark.conf.get(C.OPEN_FILES, None)
    C.save_catalog(catalog, str(tmp_path / "c"), in_order=True)
    assert spark.conf.get(C.OPEN_FILES, None) == before
    back = C.read_catalog(spark, str(tmp_path / "c"))
    assert back.exceptAll(catalog).isEmpty() and catalog.exceptAll(back).isEmpty()
    assert {p.name for p in (tmp_path / "c").glob("*/*")} == {"file_type=SNAP", "file_type=SST"}
    parts = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "c").rglob("*.parquet"))) <= 2 * max(parts, catalog.rdd.getNumPartitions())


def test_rounds_end_when_every_node_has_its_manifest(spark):
    rows = [("c", token, at, f"m{token}-{at}", True) for token in "12" for at in range(20)]
    candidates = spark.createDataFrame(rows, "cluster string, token string, snapshot_ms bigint, manifest_path string, available boolean")
    calls = []

    def verdicts_of(asked):
        calls.append(asked.count())
        return asked.withColumn("valid", F.col("snapshot_ms") >= 18)

    found = verify.newest_valid_in_rounds(candidates, verdicts_of)
    assert {r.manifest_path for r in found.collect()} == {"m1-19", "m2-19"} and calls == [2]
    assert verify.newest_valid_in_rounds(candidates, verdicts_of, "snapshot_ms = 19").count() == 2 and calls == [2]


def test_sink_files_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([("p", "m", {"a": "b"})], "remote_path string, message string, attributes map<string,string>")
    notify.notify_sink(rows, str(tmp_path), 0)
    assert {p.suffix for p in (tmp_path / "messages").rglob("part-*")} == {".gz"}
    assert [tuple(r) for r in notify.read_sink(spark, str(tmp_path)).collect()] == [("p", "m", {"a": "b"})]


def test_report_rows_stay_where_they_are(spark):
    paths = [f"store/us-east-1/alpha/{m % 3}/20000101{m // 60:02d}{m % 60:02d}/SST/ks/t/f{m}" for m in range(300)]
    catalog = C.valid_rows(C.build_catalog(spark.createDataFrame([(p, 1, None) for p in paths], LISTING)))
    listed = filters.list_by_type(catalog, DateRange(0, 10**13), "SST", "b")
    assert "Exchange hash" not in plan_of(listed)
    assert {(r.token, r.num_files) for r in listed.collect()} == {("0", 100), ("1", 100), ("2", 100)}


def test_shuffles_get_partitions_by_the_bytes_of_the_input(spark, folder, monkeypatch):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get(FIRST_PARTITIONS, None) is None and spark.conf.get(MERGED_BYTES, None) is None
    fit_shuffles(spark, 100 * INPUT_PER_PARTITION)
    assert (spark.conf.get(FIRST_PARTITIONS), spark.conf.get(MERGED_BYTES)) == ("100", "8m")
    fit_shuffles(spark, 200 * INPUT_PER_PARTITION)
    assert spark.conf.get(FIRST_PARTITIONS) == "200" and spark.conf.get("spark.sql.shuffle.partitions") == own
    fit_shuffles(spark, 1)
    assert spark.conf.get(FIRST_PARTITIONS, None) is None and spark.conf.get(MERGED_BYTES, None) is None
    spark.conf.set(FIRST_PARTITIONS, "7")
    try:
        fit_shuffles(spark, 100 * INPUT_PER_PARTITION)
        assert spark.conf.get(FIRST_PARTITIONS) == "7"
        fit_shuffles(spark, 1)
        assert spark.conf.get(FIRST_PARTITIONS) == "7" and spark.conf.get(MERGED_BYTES, None) is None
    finally:
        spark.conf.unset(FIRST_PARTITIONS)
    asked = []
    monkeypatch.setattr(stored_tables, "fit_shuffles", lambda session, size: asked.append(size))
    stored_tables.stored(spark, "fitted", [f"{folder[0]}/orders.parquet"], lambda path: None)
    assert asked[0] > 0


def test_entries_meet_the_asked_manifests_where_they_are(spark):
    rows = [("c", "1", 5, f"m{n}", True) for n in range(3)]
    asked = spark.createDataFrame(rows[:2], "cluster string, token string, snapshot_ms bigint, manifest_path string, available boolean")
    entries = spark.createDataFrame([("m0", "a"), ("m1", "a"), ("m1", "b"), ("m2", "b")], "manifest_path string, backup_path string")
    found = verify.verify_manifest_v2(asked, entries, spark.createDataFrame([("a",)], "remote_path string"), asked=True)
    semi = [line for line in plan_of(found).splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert sorted((r.manifest_path, r.files_matched, r.files_in_manifest_only, r.valid) for r in found.collect()) == [("m0", 1, 0, True), ("m1", 1, 1, False)]


def test_paths_are_parsed_by_compiled_steps(spark):
    hashed = "backup/880_app1/3/SST_V2/5/ks/t/SNAPPY/PLAINTEXT/f"
    listing = spark.createDataFrame([(hashed, 1, None), (hashed.replace("880_", "881_"), 1, None)], LISTING)
    catalog = C.build_catalog(listing)
    steps = [line for line in plan_of(catalog).splitlines() if "Generate" in line]
    assert steps and all("*(" in line for line in steps)
    assert sorted((r.error or "") for r in catalog.collect()) == ["", "bad_cluster_hash"]


def test_a_small_table_takes_no_partitions_from_a_large_one(spark, folder, monkeypatch):
    asked, sizes = [], iter([300, 5, 5])
    monkeypatch.setattr(stored_tables, "fit_shuffles", lambda session, size: asked.append(size))
    monkeypatch.setattr(stored_tables, "files_state", lambda session, paths: (1, next(sizes), 0))
    T.forget_plans()
    stored_tables.stored(spark, "large", ["a"], lambda path: stored_tables.stored(spark, "small", ["b"], lambda inner: None))
    T.forget_plans()
    stored_tables.stored(spark, "small", ["b"], lambda path: None)
    assert asked == [300, 300, 5]


def test_v1_entries_and_objects_are_shuffled_once(spark):
    node = "cluster string, token string, "
    wanted = spark.createDataFrame([("c", "1", 60_000, "m", True), ("c", "2", 60_000, "n", True), ("c", "3", 60_000, "o", True)], node + "snapshot_ms bigint, manifest_path string, available boolean")
    listed = [("1", "a", "SNAP"), ("1", "a", "SNAP"), ("1", "b", "SNAP"), ("2", "b", "SST"), ("2", None, "SNAP")]
    catalog = spark.createDataFrame([("c", t, 60_000, k, p, False) for t, p, k in listed], node + "time_ms bigint, file_type string, remote_path string, is_v2 boolean")
    entries = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "a"), ("m", "b"), ("n", "b"), ("n", None), ("o", "a")], "manifest_path string, backup_path string")
    found = verify.verify_manifest_v1(wanted, entries.repartition("backup_path").dropDuplicates(), catalog)
    by_path = [line for line in plan_of(found).splitlines() if "Exchange hashpartitioning" in line and "path" in line.split("Exchange")[1] and "manifest_path#" not in line.split("Exchange")[1]]
    assert len(by_path) == 2
    bag = verify.verify_manifest_v1(wanted, entries, catalog)
    assert sorted((r.manifest_path, r.files_matched, r.files_in_manifest_only, r.valid) for r in bag.collect()) == [("m", 3, 0, True), ("n", 0, 2, False), ("o", 0, 0, False)]


def test_the_listing_is_not_sent_to_every_task(spark):
    entries = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", None)], "manifest_path string, backup_path string")
    found = verify.missing_files(entries, spark.createDataFrame([("a",), ("a",), (None,)], "remote_path string"))
    assert "BroadcastExchange" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
    assert sorted(r.manifest_path for r in found.collect()) == ["m", "n"]


def test_manifests_are_spread_over_quarters_and_objects_are_not(spark, tmp_path):
    shipped = [datetime(1999, 4, 1), datetime(1999, 12, 31), datetime(2000, 1, 1), datetime(2000, 1, 2), datetime(2000, 2, 29), datetime(2000, 3, 31), datetime(2000, 4, 1), None]
    taken = [datetime(1999, 4, 1), datetime(2000, 1, 1), datetime(2000, 5, 1), datetime(2001, 1, 1), datetime(2001, 3, 31), datetime(2001, 4, 1), None]
    orders = [(n, cust, "F", 1.0, at, "1-X") for n, (cust, at) in enumerate((c, at) for c in (1, -12, None) for at in taken)]
    lines = [(o[0], part, 1, 2.0, at) for o in orders for at in shipped for part in (1, -2, 3, 2**62, None)]
    spark.createDataFrame(orders, T.SCHEMAS["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, T.SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    T.forget_plans()
    found = T.entries_v1(spark, str(tmp_path))
    exploded = [line for line in plan_of(found).splitlines() if "Generate explode" in line]
    dated = [line for line in plan_of(found).splitlines() if "date_format" in line]
    assert len(exploded) == 1 and "snapshot_ms" in exploded[0] and "last_modified_ms" not in exploded[0]
    assert dated and all("last_modified_ms" not in line for line in dated)
    moments = lambda at: int((at - datetime(1970, 1, 1)).total_seconds()) * 1000
    quarters = {datetime(at.year, (at.month - 1) // 3 * 3 + 1, 1) for at in taken if at}
    wanted = sorted(
        (f"app{app}", str(node), moments(q), f"backup/us-east-1/app{app}/{node}/{q:%Y%m%d%H%M}/SNAP/ks{ks}/cf{cf}/mc-{part}-Index.db")
        for app, node in ((1, 1), (0, -2)) for q in quarters for at in shipped if at and moments(q) - T.YEAR <= moments(at) <= moments(q)
        for part, ks, cf in ((1, 1, 1), (-2, -2, -2), (2**62, 2**62 % 7, 2**62 % 11))
    )
    assert wanted and sorted(tuple(r) for r in found.select("cluster", "token", "snapshot_ms", "backup_path").collect()) == wanted
    assert T.objects(spark, str(tmp_path)).count() == 3 * len(shipped) * 5


def test_parts_are_collected_without_a_sort_while_few_paths_are_held(spark, tmp_path, monkeypatch):
    rows = [("c", "1", 60_000, f"x/{n:04d}") for n in range(2_000)]
    files = spark.createDataFrame(rows, "cluster string, token string, snapshot_ms bigint, backup_path string").coalesce(1)
    snapshots = spark.createDataFrame([("c", "1", 60_000, "m")], "cluster string, token string, snapshot_ms bigint, manifest_path string")
    name, asked, held = manifests.HELD_GROUPS, [], manifests._parts_held

    def watched(session, files_per_part):
        asked.append(files_per_part)
        return held(session, files_per_part)

    monkeypatch.setattr(manifests, "_parts_held", watched)
    for per_part in (4, None):
        path = f"{tmp_path}/{per_part}"
        manifests.write_manifests(manifests.build_manifest_v1(files, 4), snapshots, path, per_part)
        parts = spark.read.parquet(f"{path}/parts")
        assert parts.count() > 128 and parts.agg(F.sum("n_files")).first()[0] == 2_000
        listed = parts.select(F.explode(F.from_json("document", "array<string>"))).collect()
        assert sorted(r[0] for r in listed) == [r[3] for r in rows]
    assert asked == [4, None] and spark.conf.get(name, None) is None
    with held(spark, 100):
        assert spark.conf.get(name) == "5000"
    for few in (None, 10_000):
        with held(spark, few):
            assert spark.conf.get(name, None) is None
    spark.conf.set(name, "128")
    try:
        with held(spark, 100):
            assert spark.conf.get(name) == "128"
    finally:
        spark.conf.unset(name)


def test_only_documents_of_asked_manifests_are_parsed_and_each_once(spark, folder):
    path, _ = folder
    T.forget_plans()
    entries = stores.entries_v2(spark, path)
    picked = entries.groupBy("manifest_path").count().orderBy("manifest_path").first()
    asked = spark.createDataFrame([(picked.manifest_path,), (picked.manifest_path,), ("other",), (None,)], "manifest_path string")
    of = stores.entries_asked_v2(spark, path)
    for wanted in (manifests.entries_of(of, asked), manifests.entries_of(of, asked).select("manifest_path", "backup_path")):
        lines = plan_of(wanted).splitlines()
        parsed = [n for n, line in enumerate(lines) if "from_json(" in line]
        met = [n for n, line in enumerate(lines) if "LeftSemi" in line]
        assert len(parsed) == 1 and lines[parsed[0]].count("from_json(") == 1 and met and parsed[0] < min(met)
    assert manifests.entries_of(of, asked).count() == picked["count"] > 0
    assert manifests.entries_of(entries, asked).exceptAll(manifests.entries_of(of, asked)).isEmpty()
    assert sum(line.count("from_json(") for line in plan_of(entries.select("backup_path")).splitlines()) == 1


def test_documents_are_grouped_as_their_sorted_files_come(spark, tmp_path):
    node = "cluster string, token string, snapshot_ms bigint, "
    names = [f"mc-{n}-{kind}" for n in range(300) for kind in ("Data.db", "Index.db")] * 2 + [None, "plain"]
    rows = [("c", t, 60_000, ks, "cf", name, n % 3, 5, f"{t}/{ks}/{name}", None if t == "3" else f"r{t}") for t in "123" for ks in ("k1", "k2", None) for n, name in enumerate(names)]
    files = spark.createDataFrame(rows, node + "keyspace string, column_family string, file_name string, size bigint, last_modified_ms bigint, backup_path string, region string")
    files = files.withColumns({"rack": F.lit("r1"), "creation_ms": F.col("last_modified_ms"), "compression": F.lit("LZ4"), "encryption": F.lit("PLAINTEXT")})
    listing = spark.createDataFrame([(f"1/k1/{n}",) for n in names if n and "Data" in n], "remote_path string")
    built = manifests.build_manifest_v2(files, listing, 7)
    before = spark.conf.get(manifests.SORTED_GROUPS, None)
    snapshots = spark.createDataFrame([("c", "1", 60_000, "m"), ("c", "2", 60_000, "n")], node + "manifest_path string")
    with manifests._parts_held(spark, None):
        grouping = [line.split("(")[0] for line in plan_of(built).splitlines() if "collect_" in line]
        assert len(grouping) == 2 and all("SortAggregate" in line for line in grouping)
        assert sum("Exchange hash" in line and "file_name" not in line for line in plan_of(built).splitlines()) == 2
    assert spark.conf.get(manifests.SORTED_GROUPS, None) == before
    manifests.write_manifests(built, snapshots, str(tmp_path / "m"))
    there = spark.read.parquet(str(tmp_path / "m/parts"))
    assert there.exceptAll(built).isEmpty() and built.exceptAll(there).isEmpty()
    found = {}
    for r in read_manifest_v2(there.select("file_name", "document")).collect():
        found.setdefault((r.token, r.keyspace), set()).add((r.prefix, r.file_name, r.size, r.is_uploaded))
    wanted = {(name.rsplit("-", 1)[0], name, n % 3, ks == "k1" and "Data" in name) for ks in ("k1",) for n, name in enumerate(names) if name and "-" in name}
    assert found[("1", "k1")] == wanted and set(found) == {("1", "k1"), ("1", "k2"), ("2", "k1"), ("2", "k2")}
    assert there.groupBy("token", "keyspace", "part_no").count().filter("count > 1").isEmpty()
    assert {r.n for r in there.groupBy("token", "keyspace").agg(F.count_distinct("part_no").alias("n")).collect()} <= set(range(30, 44))
