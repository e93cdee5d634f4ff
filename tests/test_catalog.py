import math
import random

import pytest
from pyspark.sql import functions as F

from snapops.constants import DAY_MS, HOUR_MS
from snapops.operators import catalog as C
from snapops.operators import filters, orphans, restore, retention, uploads, verify
from snapops.operators import manifests as M
from snapops.ranges import DateRange
from snapops.schemas import LISTING
from snapops.sources import listing as L
from snapops.sources import manifests as S
from snapops.sources.stored import stored

def listing(spark, paths):
    return spark.createDataFrame([(p, 1, None) for p in paths], LISTING)


def folder(cluster):
    """``<hash mod 10000>_<cluster>`` by the definition of the string hash."""
    total = 0
    for c in cluster:
        total = (31 * total + ord(c)) % 2**32
    signed = total - 2**32 if total >= 2**31 else total
    return f"{int(math.fmod(signed, 10_000))}_{cluster}"


def v2(cluster, token, kind, at, name, table=("orders_ks", "lines")):
    inner = "/".join(table) + "/" if kind == "SST_V2" else ""
    return f"store/{folder(cluster)}/{token}/{kind}/{at}/{inner}LZ4/PLAINTEXT/{name}"


def v1(cluster, token, minute, kind, name, table=("orders_ks", "lines")):
    inner = "/".join(table) + "/" if kind in ("SNAP", "SST") else ""
    return f"store/north/{cluster}/{token}/{minute}/{kind}/{inner}{name}"


def test_paths_parse_and_round_trip(spark):
    draw = random.Random(3)
    expected = {}
    for i in range(60):
        cluster, token, at = draw.choice(["alpha", "be_ta", "gamma-7"]), str(draw.randrange(10**20)), draw.randrange(10**6) * 1000
        kind = draw.choice(["SST_V2", "META_V2", "SNAP", "SST", "META", "CL"])
        minute = f"2021{draw.randint(1, 12):02d}{draw.randint(1, 28):02d}{draw.randint(0, 23):02d}{draw.randint(0, 59):02d}"
        path = v2(cluster, token, kind, at, f"n{i}.db") if kind.endswith("_V2") else v1(cluster, token, minute, kind, f"n{i}.db")
        expected[path] = (cluster, token, kind, kind in ("SST_V2", "SNAP", "SST"), f"n{i}.db")
    rows = C.reencode_catalog(C.build_catalog(listing(spark, expected))).collect()
    assert {r.remote_path: (r.cluster, r.token, r.file_type, r.is_data, r.file_name) for r in rows} == expected
    assert all(r.round_trips and r.error is None for r in rows)


def test_paths_that_cannot_be_read(spark):
    good = v2("alpha", "5", "SST_V2", 7000, "x.db")
    expected = {
        good: None,
        good.replace(folder("alpha"), "77_alpha"): "bad_cluster_hash",
        good.replace("/7000/", "/noon/"): "bad_last_modified",
        good.replace("/LZ4/", "/BROTLI/"): "unknown_compression",
        good.replace("/PLAINTEXT/", "/ENIGMA/"): "unknown_encryption",
        good.replace("/LZ4/PLAINTEXT", ""): "too_few_parts",
        v1("alpha", "5", "202105040302", "TAPE", "k/t/x.db"): "unknown_type",
        "store/alone": "too_few_parts",
    }
    assert {r.remote_path: r.error for r in C.build_catalog(listing(spark, expected)).collect()} == expected


def test_keyspace_named_like_an_older_type_reads_as_v1(spark):
    row = C.build_catalog(listing(spark, [v2("alpha", "1", "SST_V2", 1, "f", ("META", "t"))])).first()
    assert (row.is_v2, row.file_type, row.error) == (False, "META", None)


def test_milliseconds_are_cut_to_seconds(spark):
    path = v2("alpha", "1", "META_V2", 86_399_999, "m")
    row = C.build_catalog(listing(spark, [path]))
    assert row.select(C.remote_path().alias("p")).first().p == path.replace("86399999", "86399000")


def drops(include, exclude, keyspace, table):
    """The rule in plain words: never, then exclude, then include; without a name nothing is dropped."""
    if not keyspace or not table:
        return False
    name = table.split("-")[0]

    def listed(text):
        return any(k == keyspace and t.split("-")[0] in ("*", name) for k, t in (e.split(".") for e in text.split(",")))

    if keyspace == "system" and name in ("local", "peers", "hints", "compactions_in_progress", "LocationInfo"):
        return True
    return bool(exclude and listed(exclude)) or bool(include and not listed(include))


def test_table_filters_follow_the_rule(spark):
    draw = random.Random(8)
    keyspaces, tables = ["sales", "sale", "stock", "system"], ["item", "items", "peers", "hints", "item-9f3"]
    cases = []
    for _ in range(120):
        entry = lambda: f"{draw.choice(keyspaces)}.{draw.choice([*tables, '*'])}"
        # a keyspace is listed either whole or by tables
        lists = [None if draw.random() < 0.3 else ",".join({e.split(".")[0]: e for e in (entry() for _ in range(draw.randint(1, 3)))}.values()) for _ in range(2)]
        cases.append((*lists, draw.choice([*keyspaces, None, ""]), draw.choice([*tables, ""])))
    columns = [filters.is_filtered(F.lit(k).cast("string"), F.lit(t), i, e).alias(f"c{n}") for n, (i, e, k, t) in enumerate(cases)]
    assert list(spark.range(1).select(*columns).first()) == [drops(*c) for c in cases]


@pytest.mark.parametrize("text", ["sales", "sales.item,stock", ".item", "sales."])
def test_bad_table_filter(text):
    with pytest.raises(ValueError):
        filters.TableList.parse(text)


NAMED = "cluster string, token string, keyspace string, column_family string, file_name string, modified_ms bigint"


def test_orphans_follow_the_rule(spark):
    draw = random.Random(21)
    now, grace = 1_700_000_000_000, 2
    ages = {f"nb-{i}-Data.db": draw.randint(0, 6 * 24) for i in range(40)}
    ages |= {"nb-90-Data.db": 48, "nb-91-Data.db.tmp": 100, "nb-92-Data.db": 49}
    kept = {n for n in ages if draw.random() < 0.5}
    node = ("alpha", "7", "sales", "item")
    files = spark.createDataFrame([(*node, n, now - h * 3_600_000) for n, h in ages.items()], NAMED)
    old = {n for n, h in ages.items() if h >= grace * 24 and not n.endswith(".tmp")}
    assert {r.file_name for r in filters.orphan_candidates(files, now, grace).collect()} == old
    found = orphans.orphan_files(files, files.filter(F.col("file_name").isin(sorted(kept))), now, grace)
    assert {r.file_name for r in found.collect()} == old - kept

    marked = {n: now - draw.randint(0, 5) * DAY_MS for n in sorted(ages) if draw.random() < 0.4}
    marks = files.filter(F.col("file_name").isin(sorted(marked))).withColumn("marked_ms", F.element_at(F.create_map(*(F.lit(x) for pair in marked.items() for x in pair)), F.col("file_name")))
    steps = {r.file_name: r for r in orphans.orphan_lifecycle(found, marks, now, grace_days=3, move_enabled=True).collect()}
    for n in old - kept | set(marked):
        action = "UNLINK" if n not in old - kept else "LINK" if n not in marked else "MOVE" if marked[n] < now - 3 * DAY_MS else "WAIT"
        assert steps[n].action == action
    assert len(steps) == len(old - kept | set(marked))


def plain_retention(objects, manifests, whole, as_of, days, grace):
    """Per node: what goes, by the rule."""
    start, gone = as_of - days * DAY_MS, set()
    for node in {o[0] for o in objects}:
        inside = sorted((at, path) for n, at, path, _ in manifests if n == node and start <= at <= as_of)
        if not inside or inside[0][1] not in whole:
            continue
        keep = next(set(files) for n, _, path, files in manifests if path == inside[0][1])
        if keep:
            gone |= {path for n, at, path, _ in manifests if n == node and at <= start - HOUR_MS}
            gone |= {path for n, at, path in objects if n == node and at <= start - grace * DAY_MS and path not in keep}
    return gone


def test_retention_follows_the_rule(spark):
    draw = random.Random(2)
    as_of, days, grace = 1_700_000_000_000, 10, 3
    objects, manifests = [], []
    for token in map(str, range(12)):
        own = [(token, at, v2("alpha", token, "SST_V2", at, f"nb-{i}-Data.db")) for i, at in enumerate(sorted(as_of - draw.randrange(30 * 24) * HOUR_MS for _ in range(25)))]
        objects += own
        for at in sorted({as_of - draw.randrange(30 * 24) * HOUR_MS for _ in range(draw.randint(0, 4))} | ({as_of - days * DAY_MS} if token == "3" else set())):
            files = [p for _, t, p in own if t <= at and draw.random() < 0.6]
            manifests.append((token, at, v2("alpha", token, "META_V2", at, "m.json"), files))
    catalog = C.build_catalog(listing(spark, [o[2] for o in objects] + [m[2] for m in manifests]))
    entries = spark.createDataFrame([("alpha", n, path, f) for n, _, path, files in manifests for f in files], "cluster string, token string, manifest_path string, backup_path string")
    whole = {m[2] for m in manifests if draw.random() < 0.8}
    judged = spark.createDataFrame([(m[2], m[2] in whole) for m in manifests], "manifest_path string, available boolean")

    def deleted(known):
        plan = retention.retention_plan(catalog, entries, known, as_of, days, grace, feature_start_ms=0)
        return {r.remote_path for r in plan.collect()}

    expected = plain_retention(objects, manifests, whole, as_of, days, grace)
    assert deleted(judged) == expected and expected
    assert deleted(judged.filter("available")) == expected
    assert deleted(judged.limit(0)) == set()


def test_lifecycle_rules(spark):
    prefixes = spark.createDataFrame([("A", 5), ("b", 0), ("c", 5), ("d", 5), ("e", 0), ("f", 5)], "prefix string, retention_days int")
    rules = spark.createDataFrame(
        [(1, "a", 5, "Enabled"), (2, "a", 9, "Enabled"), (3, "b", 5, "Enabled"), (4, "c", 6, "Enabled"), (5, "f", 5, "Disabled")],
        "rule_no int, prefix string, expiration_days int, status string",
    )
    found = {r.prefix: r.action for r in retention.lifecycle_rule_plan(prefixes, rules).collect()}
    assert found == {"A": "NONE", "b": "REMOVE", "c": "UPDATE", "d": "ADD", "e": "NONE", "f": "UPDATE"}


def v1_inputs(spark, listed, named, minute="202203140915"):
    """One node's snapshot: the paths listed in the store and the paths its manifest names."""
    meta = v1("alpha", "88", minute, "META", "meta.json")
    snap = lambda n: v1("alpha", "88", minute, "SNAP", f"nb-{n}-Data.db")
    catalog = C.build_catalog(listing(spark, [meta if n == "meta" else snap(n) for n in listed]))
    entries = spark.createDataFrame([(meta, snap(n), 1) for n in named], "manifest_path string, backup_path string, size bigint")
    judged = spark.createDataFrame([(meta, True)], "manifest_path string, available boolean")
    return catalog, entries, verify.verify_manifest_v1(verify.manifests_in_catalog(catalog, judged), entries, catalog)


def test_restore_v1_follows_the_rule(spark):
    draw = random.Random(6)
    snapshot, minutes = "202203140915", [f"2022031409{m:02d}" for m in range(10, 60)]
    tables = [("sales", "item"), ("sales", "price"), ("stock", "item")]
    meta = v1("alpha", "88", snapshot, "META", "meta.json")
    snaps = {v1("alpha", "88", snapshot, "SNAP", f"nb-{i}-Data.db", t): t for i, t in enumerate(draw.choices(tables, k=12))}
    later = {v1("alpha", "88", m, "SST", f"nb-{i}-Data.db", t): (m, t) for i, (m, t) in enumerate(zip(draw.choices(minutes, k=40), draw.choices(tables, k=40), strict=True))}
    logs = {v1("alpha", "88", m, "CL", f"log-{m}"): m for m in minutes}
    catalog = C.build_catalog(listing(spark, [meta, *snaps, *later, *logs]))
    entries = spark.createDataFrame([(meta, p, 1) for p in snaps], "manifest_path string, backup_path string, size bigint")
    judged = spark.createDataFrame([(meta, True)], "manifest_path string, available boolean")
    verdicts = verify.verify_manifest_v1(verify.manifests_in_catalog(catalog, judged), entries, catalog)

    def plan(end, **options):
        rows = restore.restore_plan(catalog, entries, verdicts, DateRange.parse(f"202203140900,{end}", 0), v2=False, **options)
        return {r.remote_path for r in rows.collect()}

    end = "202203140930"
    within = {p for p, (m, _) in later.items() if snapshot <= m < end}
    assert plan(end, incrementals=False) == set(snaps)
    assert plan(end, exclude="sales.*") == {p for p, t in snaps.items() if t[0] != "sales"} | {p for p in within if later[p][1][0] != "sales"}
    newest = sorted(p for p, m in logs.items() if snapshot <= m < end)[-4:]
    assert plan(end, commit_logs=4) == set(snaps) | within | set(newest)
    assert plan("202203141000") == set(snaps) | {p for p, (m, _) in later.items() if snapshot <= m < "202203141000"}
    assert plan("202203140915") == set()
    racks = spark.createDataFrame([("alpha", "88", "rack-2")], "cluster string, token string, rack string")
    assert plan("202203140930", racks=racks, backup_racks=["rack-1"]) == set()
    assert plan("202203140930", racks=racks, backup_racks=["rack-1", "rack-2"]) == set(snaps) | within


@pytest.mark.parametrize(
    "listed, named, matched, missing, valid",
    [
        (["meta", "1", "2"], ["1", "2"], 2, 0, True),
        (["meta", "1"], ["1", "2"], 1, 1, False),
        (["meta"], [], 0, 0, True),
        (["meta", "1"], [], 0, 0, True),
        (["meta", "1", "1"], ["1", "1", "2"], 2, 1, False),
        (["meta", "1"], ["1", "1"], 1, 0, True),
    ],
)
def test_verify_v1(spark, listed, named, matched, missing, valid):
    row = v1_inputs(spark, listed, named)[2].first()
    assert (row.files_matched, row.files_in_manifest_only, row.valid) == (matched, missing, valid)


def test_compression_choice(spark):
    rows = [
        ("SST_V2", "/d/a/mc-1-Data.db", 10), ("SST_V2", "/d/a/mc-1-CompressionInfo.db", 10), ("SST_V2", "/d/a/mc-2-Data.db", 10),
        ("SST_V2", "/d/b/mc-1-Data.db", 10), ("SST_V2", "/d/a/mc-1-Index.db", 4), ("SST", "/d/a/mc-1-Data.db", 10), ("SST_V2", "/d/a/manifest.json", 10),
    ]
    files = spark.createDataFrame(
        [("c", "1", t, p, p.split("/")[-1], m) for t, p, m in rows],
        "cluster string, token string, file_type string, local_path string, file_name string, last_modified_ms bigint",
    )

    def codecs(setting):
        return {(r.file_type, r.local_path): r.compression for r in uploads.compression_choice(files, setting, 5).collect()}

    picked = codecs("IF_REQUIRED")
    none = {("SST_V2", "/d/a/mc-1-Data.db"), ("SST_V2", "/d/a/mc-1-CompressionInfo.db")}
    assert {k for k, v in picked.items() if v == "NONE"} == none
    assert set(codecs("ALL").values()) == {"SNAPPY"}
    assert {k for k, v in codecs("NONE").items() if v == "SNAPPY"} == {("SST_V2", "/d/a/mc-1-Index.db"), ("SST", "/d/a/mc-1-Data.db")}
    with pytest.raises(ValueError):
        uploads.compression_choice(files, "SOME")
    passes = {r.local_path: r.upload_pass for r in uploads.upload_order(files).collect()}
    assert passes == {p: int(p.endswith("-Data.db")) for _, p, _ in rows}


def test_upload_todo_lists_a_file_once(spark):
    files = spark.createDataFrame(
        [("c", "1", "SST_V2", "/a", "r/a"), ("c", "1", "SST_V2", "/a", "r/a"), ("c", "1", "SST_V2", "/b", "r/b"), ("c", "1", "SNAP", "/c", "r/b")],
        "cluster string, token string, file_type string, local_path string, remote_path string",
    )
    todo = uploads.upload_todo(files, listing(spark, ["r/b"]))
    assert sorted(r.local_path for r in todo.collect()) == ["/a", "/c"]


def test_manifest_files_round_trip(spark, tmp_path):
    names = ["mc-1-Data.db", "mc-1-Index.db", "mc-2-Data.db", "manifest.json", "nodash"]
    files = spark.createDataFrame(
        [("app0", "1", 1_700_000_040_000, "r", "k", "ks", "cf", n, 5, 5, 9, "SNAPPY", "PLAINTEXT", f"p/{n}") for n in names],
        "cluster string, token string, snapshot_ms bigint, region string, rack string, keyspace string, column_family string, "
        "file_name string, last_modified_ms bigint, creation_ms bigint, size bigint, compression string, encryption string, backup_path string",
    )
    built = M.build_manifest_v2(files, listing(spark, ["p/mc-1-Data.db"]), sstables_per_part=1)
    rows = S.read_manifest_v2(built.select("file_name", "document")).collect()
    assert {r.file_name: r.prefix for r in rows} == {"mc-1-Data.db": "mc-1", "mc-1-Index.db": "mc-1", "mc-2-Data.db": "mc-2", "manifest.json": "manifest"}
    assert [r.file_name for r in rows if r.is_uploaded] == ["mc-1-Data.db"]
    for i, r in enumerate(built.collect()):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "meta_v2_202311142214.json").write_text(r.document)
    (tmp_path / "other.json").write_text("{}")
    read = S.read_manifest_v2(S.read_manifest_files(spark, str(tmp_path)))
    assert sorted(r.backup_path for r in read.collect()) == sorted(f"p/{n}" for n in names[:4])


def test_file_tree(spark, tmp_path):
    for name in ["ks/cf-1/mc-1-Data.db", "ks/cf-1/snapshots/s1/mc-1-Data.db", "ks/cf-1/backups/mc-2-Data.db"]:
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    tree = L.read_file_tree(spark, str(tmp_path / "data")).withColumn("local_path", F.regexp_replace("remote_path", "^file:", ""))
    files = L.scan_data_dir(tree, str(tmp_path / "data"))
    assert {(r.keyspace, r.column_family, r.folder, r.snapshot_name, r.file_name) for r in files.collect()} == {
        ("ks", "cf", None, None, "mc-1-Data.db"), ("ks", "cf", "snapshots", "s1", "mc-1-Data.db"), ("ks", "cf", "backups", None, "mc-2-Data.db")
    }


def test_keep_largest(spark):
    draw = random.Random(4)
    rows = [(draw.choice("xyz"), draw.randrange(40)) for _ in range(200)]
    kept = restore.keep_largest_n(spark.createDataFrame(rows, "g string, n int"), "n", 7, ["g"])
    expected = {(g, n) for g in "xyz" for n in sorted({n for h, n in rows if h == g})[-7:]}
    assert {tuple(r) for r in kept.collect()} == expected
    alone = restore.keep_largest_n(spark.createDataFrame(rows, "g string, n int").select("n"), "n", 5)
    assert [r.n for r in alone.collect()] == sorted({n for _, n in rows})[-5:][::-1]


def scanned(frame):
    """Files opened and rows read by the scan of a collected frame."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numFiles").value(), plan.metrics().apply("numOutputRows").value()


def test_saved_catalog_is_read_pruned(spark, tmp_path):
    paths = [v2("alpha", "1", "SST_V2", h * HOUR_MS, f"nb-{h}-Data.db") for h in range(2000)] + [v2("alpha", "1", "META_V2", h * HOUR_MS, "m.json") for h in range(0, 2000, 50)]
    C.save_catalog(C.build_catalog(listing(spark, paths)), str(tmp_path / "c"), rows_per_file=100)
    table = C.read_catalog(spark, str(tmp_path / "c"))
    assert table.columns == C.build_catalog(listing(spark, paths)).columns
    total = len(list((tmp_path / "c").rglob("*.parquet")))
    span = DateRange(100 * HOUR_MS, 300 * HOUR_MS)

    manifests = filters.find_manifests_v2(table, span)
    assert len(manifests.collect()) == 5
    found = filters.incrementals_v2(table, span)
    assert len(found.collect()) == 201
    files, rows = scanned(found)
    assert files < total and rows <= 400, "one type's folder, and of it the files of the span"
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(file_type" in plan and "GreaterThanOrEqual(last_modified_ms" in plan
    assert filters.list_v1_range(table, span).count() == 0

    L.save_listing(listing(spark, paths), str(tmp_path / "l"), rows_per_file=100)
    prefix = v2("alpha", "1", "SST_V2", 10, "x").rsplit("/", 6)[0] + "/"
    keys = L.scan_listing(L.read_listing(spark, str(tmp_path / "l")), prefix, prefix + "7000")
    assert len(keys.collect()) == sum(p.startswith(prefix) and p > prefix + "7000" for p in paths)
    assert scanned(keys)[1] < len(paths) / 2


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    calls = []

    def write(path):
        calls.append(path)
        spark.range(len(calls)).write.parquet(path)

    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    first = stored(spark, "t", [source], write)
    assert stored(spark, "t", [source], write) == first and len(calls) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert stored(spark, "t", [source], write) != first and len(calls) == 2
