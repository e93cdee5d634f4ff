import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from snapops.operators import admin, chunks, gossip, health, notify, pacing, ring, verify
from snapops.operators import settings as V
from snapops.operators import status as S
from snapops.ranges import DateRange
from snapops.schemas import RING_INSTANCE, STATUS_EVENT
from snapops.sources import gossip_dump
from snapops.sources import settings as sources


def events(spark, rows):
    return spark.createDataFrame([("c", "1", 2, *r) for r in rows], STATUS_EVENT)


def test_status_fold(spark):
    rows = [
        (100, 100, 1, "STARTED", None, False, None, None),
        (100, 150, 2, "FINISHED", None, True, "b/m1", None),
        (100, 190, 3, "FINISHED", 150, True, "b/m1", 180),
        (200, 200, 4, "STARTED", None, False, None, None),
        (200, 260, 5, "FAILED", None, False, None, None),
        (300, 300, 6, "STARTED", None, False, None, None),
        (None, 1, 7, "STARTED", None, False, None, None),
    ]
    found = {r.start_ms: r for r in S.status_fold(events(spark, rows)).collect()}
    assert {k: (r.status, r.completed_ms, r.last_validated_ms) for k, r in found.items()} == {
        100: ("FINISHED", 150, 180), 200: ("FAILED", 260, None), 300: ("STARTED", None, None)
    }
    newest = S.latest_backup_metadata(S.status_fold(events(spark, rows)), 2, DateRange(100, 300)).collect()
    assert [r.start_ms for r in newest] == [100]


def test_verification_of_runs(spark):
    rows = [(d, d, d, "FINISHED", d, True, f"m{d}", 5 if d == 100 else None) for d in (100, 200, 300)]
    runs = S.status_fold(events(spark, rows))
    verdicts = spark.createDataFrame([("m100", False), ("m200", True), ("m300", False)], "manifest_path string, valid boolean")
    span = DateRange(0, 1000)
    assert verify.verify_latest_backup(runs, verdicts, 2, span).first().start_ms == 200
    older = DateRange(0, 150)
    assert verify.verify_latest_backup(runs, verdicts, 2, older).first().start_ms == 100
    assert verify.verify_latest_backup(runs, verdicts, 2, older, force=True).count() == 0
    assert {r.start_ms for r in verify.verify_backups_in_range(runs, verdicts, 2, span).collect()} == {100, 200}
    breach = verify.slo_breaches(runs, runs, verdicts, 2, 86_400_000 + 250).first()
    assert (breach.verified, breach.breached) == (0, True)


def test_keep_last_days(spark):
    rows = [("c", "1", f"2020010{d}", 10 - d) for d in range(1, 8)]
    days = spark.createDataFrame(rows, "cluster string, token string, snapshot_date string, seq bigint")
    kept = S.keep_last_days(days, "seq", 3)
    assert {r.snapshot_date for r in kept.collect()} == {"20200101", "20200102", "20200103"}


def test_status_store_replaces_only_given_days(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(d * 86_400_000, 1, d, "STARTED", None, False, None, None) for d in (1, 2)]
    S.save_status(S.status_fold(events(spark, rows)), path)
    S.save_status(S.status_fold(events(spark, [(2 * 86_400_000, 9, 9, "FAILED", None, False, None, None)])), path)
    assert {r.start_ms // 86_400_000: r.status for r in S.load_status(spark, path).collect()} == {1: "STARTED", 2: "FAILED"}
    assert S.load_status(spark, path, "19700103").count() == 1


@pytest.mark.parametrize(
    "views, expected",
    [
        ([("a", True)] * 3, ("GOOD", "a", True)),
        ([("a", False), ("A", False), ("a", False)], ("GOOD", "a", False)),
        ([("a", True), ("b", True), ("a", True)], ("MISMATCH", "a", True)),
        ([("a", False), ("a", True)], ("MISMATCH", "a", True)),
        ([("a", True), ("a", True)], ("GOOD", "a", True)),
        ([("a", True), None, None, None], ("UNREACHABLE_NODES", "a", True)),
        ([None, None], ("UNREACHABLE_NODES", None, None)),
        ([None, ("a", True), ("a", True), None, ("a", True), ("b", True)], ("GOOD", "a", True)),
    ],
)
def test_gossip_consensus(spark, views, expected):
    rows = [("a", "d", "t", i, v is not None, *(v or (None, None))) for i, v in enumerate(views)]
    rows += [("b", "d", "t", 0, True, "elsewhere", True)]  # the same token in another application
    seen = spark.createDataFrame(rows, "app string, dc string, token string, seq long, reachable boolean, ip string, live boolean")
    found = {r.app: (r.status, r.ip, r.live) for r in gossip.gossip_consensus(seen).collect()}
    assert found == {"a": expected, "b": ("GOOD", "elsewhere", True)}


def test_observers_are_of_the_same_application_and_dc(spark):
    rows = [("a", "5", "5", "east"), ("a", "5", "6", "EAST"), ("a", "5", "7", "west"), ("b", "5", "6", "east"), ("a", "8", "6", "east")]
    seen = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "app string, token string, observer_token string, observer_dc string, seq int")
    asked = spark.createDataFrame([("a", "east", "5"), ("a", "west", "5")], "app string, dc string, token string")
    assert {(r.dc, r.seq) for r in gossip.eligible_observations(seen, asked).collect()} == {("east", 1), ("west", 2)}


def test_replacement_decisions(spark):
    said = spark.createDataFrame(
        [("1", "GOOD", "x", True), ("2", "GOOD", "x", False), ("3", "MISMATCH", "x", True), ("4", "UNREACHABLE_NODES", None, None)],
        "token string, status string, ip string, live boolean",
    ).select(F.lit("a").alias("app"), F.lit("d").alias("dc"), "*")
    tokens = spark.createDataFrame([("a", "d", str(i), f"r{i}", "h", "p") for i in range(1, 5)] + [("b", "d", "1", "r9", "h", "p")], "app string, dc string, token string, registry_ip string, host_ip string, private_ip string")
    dead = {(r.app, r.token): r.replace_ip for r in gossip.replace_ip_existing(tokens, said).collect()}
    assert dead == {("a", "1"): None, ("a", "2"): "x", ("a", "3"): None, ("a", "4"): "r4", ("b", "1"): "r9"}
    own = {r.token: (r.replace_ip, r.error) for r in gossip.replace_ip_assigned(tokens, said).collect() if r.app == "a"}
    assert own == {"1": (None, "owner_alive"), "2": ("x", None), "3": (None, "gossip_mismatch"), "4": (None, None)}
    lenient = gossip.replace_ip_assigned(tokens, said, permit_mismatch=True)
    assert {(r.app, r.token): r.error for r in lenient.collect()}["a", "3"] is None


def test_claims_give_no_token_twice(spark):
    draw = random.Random(12)
    decided, dead = [], []
    for i in range(120):
        rack, slot = f"r{draw.randrange(3)}", draw.random() < 0.2
        dead.append(("a", rack, draw.choice(["east", "west"]), i, str(i * 10), slot))
        decided.append(("a", dead[-1][2], str(i * 10), None if slot or draw.random() < 0.4 else f"ip{i}"))
    asking = [("a", f"r{draw.randrange(3)}", f"n{i:03d}") for i in range(100)] + [("a", "r0", "n000")] * 2 + [("a", "empty", "n900")]
    found = ring.claims(
        spark.createDataFrame(asking, "app string, rack string, instance_id string"),
        spark.createDataFrame(dead, "app string, rack string, dc string, id long, token string, pregenerated boolean"),
        spark.createDataFrame(decided, "app string, dc string, token string, replace_ip string"),
    ).collect()
    address = {t: ip for _, _, t, ip in decided}
    expected = {}
    for rack in {r for _, r, _ in asking}:
        offers = [(i, t, address[t], "dead") for _, r, _, i, t, slot in dead if r == rack and not slot and address[t]]
        offers += [(i, t, None, "slot") for _, r, _, i, t, slot in dead if r == rack and slot]
        for n, instance in enumerate(sorted({i for _, r, i in asking if r == rack})):
            expected[rack, instance] = offers[n] if n < len(offers) else (None, None, None, None)
    assert {(r.rack, r.instance_id): (r.id, r.token, r.replace_ip, r.source) for r in found} == expected
    taken = [r.token for r in found if r.token]
    assert len(taken) == len(set(taken)) and any(r.source == "slot" for r in found) and any(r.source is None for r in found)


def plain_dump(nodes):
    """A dump in the text form: a line with the address, then ``name:value`` or ``name:version:value``."""
    return "".join(f"/{ip}\n" + "".join(f"  {':'.join((name, *map(str, value)))}\n" for name, value in lines) for ip, lines in nodes)


def test_gossip_dumps_are_read_back(spark, tmp_path):
    draw = random.Random(9)
    expected, tokens = {}, {}
    for d in range(3):
        nodes = []
        for n in range(draw.randint(2, 6)):
            ip = f"192.168.{d}.{n}"
            status, beat = draw.choice(["NORMAL", "LEFT", "BOOT"]), draw.randrange(10**6)
            lines = [("generation", [n]), ("heartbeat", [beat]), ("STATUS", [7, f"{status},{draw.randrange(99)}"]), ("RACK", [3, f"rack{n}"])]
            if n % 2:
                lines.append(("TOKENS", [4, "<hidden>"]))
                tokens[ip] = f"[{n}]"
            nodes.append((ip, lines))
            expected[ip] = {"PUBLIC_IP": ip, "GENERATION": str(n), "HEARTBEAT": str(beat), "STATUS": status, "RACK": f"rack{n}"} | ({"TOKENS": tokens[ip]} if n % 2 else {})
        (tmp_path / f"dump{d}.txt").write_text(plain_dump(nodes) + "/192.168.9.9\n  short:1\n")
    known = spark.createDataFrame(list(tokens.items()), "public_ip string, tokens string")
    found = gossip_dump.parse_gossip_dump(gossip_dump.read_dumps(spark, str(tmp_path)), known).collect()
    assert {r.public_ip: r.attributes for r in found} == expected
    assert len({r.dump_id for r in found}) == 3


def instances(spark, rows):
    full = [("a", i, inst, f"h{i}", f"ip{i}", rack, dc, token, 0) for i, inst, rack, dc, token in rows]
    return spark.createDataFrame(full, RING_INSTANCE)


def test_new_token_skips_tokens_of_other_dcs(spark):
    base = 2**127 // 3
    dc_hash = {dc: abs(sum(ord(c) * 31 ** (len(dc) - 1 - i) for i, c in enumerate(dc))) for dc in ("x", "y")}
    mine = base * 1 + dc_hash["x"]
    owned = instances(spark, [(dc_hash["x"], "i", "r1", "x", "1"), (2, "i", "r2", "y", str(mine)), (3, "i", "r2", "y", str(mine + 1)), (4, "i", "r2", "y", str(mine + 3))])
    ask = "app string, rack string, dc string, rack_index long, n_racks long, rack_size long"
    row = ring.new_token_slot(spark.createDataFrame([("a", "r1", "x", 0, 1, 3)], ask), owned).first()
    assert (row.slot, row.token, row.error) == (1, str(mine + 2), None)
    clash = owned.withColumn("dc", F.when(F.col("id") == 3, "x").otherwise(F.col("dc")))
    assert ring.new_token_slot(spark.createDataFrame([("a", "r1", "x", 0, 1, 3)], ask), clash).first().error == "duplicate_in_dc"
    empty = ring.new_token_slot(spark.createDataFrame([("a", "r9", "x", 2, 1, 3)], ask), owned).first()
    assert (empty.slot, empty.token) == (2, str(base * 2 + dc_hash["x"]))


def brute_seeds(rows, me):
    out = set()
    for rack in {r[2] for r in rows}:
        for other in sorted(rows):
            if other[2] == rack and other[1] != "new_slot" and other[0] != me:
                out.add((rack, f"h{other[0]}"))
                break
    return out


def test_seeds(spark):
    rows = [(i, "new_slot" if i in (0, 4) else f"i{i}", f"r{i % 3}", "d", str(i)) for i in range(12)]
    found = {}
    for r in ring.seeds(instances(spark, rows)).collect():
        found.setdefault(r.id, set()).add((r.seed_rack, r.seed))
    assert found == {i: brute_seeds(rows, i) for i in range(12)}
    first = {r.id for r in ring.is_seed(instances(spark, rows)).collect() if r.is_seed}
    assert first == {0, 1, 2}
    single = instances(spark, [(1, "i1", "r", "d", "1"), (2, "i2", "r", "d", "2")])
    sizes = "app string, rack string, max_size long"
    assert ring.seeds(single, spark.createDataFrame([("a", "r", 3)], sizes)).count() == 0
    full = sorted((r.id, r.seed) for r in ring.seeds(single, spark.createDataFrame([("a", "r", 2)], sizes)).collect())
    assert full == [(1, "h2"), (1, "h2"), (2, "h1")]


CHANGES = "seq long, op string, app string, dc string, id long, expected_instance string, expected_token string, instance_id string, hostname string, ip string, rack string, token string"


def plain_registry(rows, changes, now):
    """The changes one after the other on a plain dictionary."""
    table, refused = {(r[0], r[6], r[1]): (r[2], r[7], r[8]) for r in rows}, []
    for seq, op, app, dc, i, instance, token, new, *_, new_token in sorted(changes):
        at = table.get((app, dc, i))
        if op == "update":
            good = at is not None and at[:2] == (instance, token)
        else:
            good = op == "delete" or at is None or (app.endswith("-dead") and at[2] < now - 180_000)
        if not good:
            refused.append(seq)
        elif op == "delete":
            table.pop((app, dc, i), None)
        else:
            table[app, dc, i] = (new, new_token, now)
    return table, sorted(refused)


def test_registry_changes_build_on_each_other(spark):
    now, draw = 10_000_000, random.Random(14)
    rows = [(app, i, f"i{i}", "h", "ip", "r", "d", str(i), now - draw.choice([1, 500_000])) for app in ("a", "a-dead") for i in range(12)]
    names = ["i0", "i1", "x", "y"]
    changes = [(0, "create", "a", "d", 99, None, None, "x", "h", "ip", "r", "1"), (1, "update", "a", "d", 99, "x", "1", "y", "h", "ip", "r", "2"), (2, "update", "a", "d", 99, "y", "2", "z", "h", "ip", "r", "3")]
    for seq in range(3, 400):
        i = draw.randrange(15)
        changes.append((seq, draw.choice(["update", "update", "create", "delete"]), draw.choice(["a", "a-dead"]), "d", i, draw.choice([f"i{i}", *names]), draw.choice([str(i), "7"]), draw.choice(names), "h", "ip", "r", draw.choice([str(i), "7"])))
    shuffled = draw.sample(changes, len(changes))
    after, refused = ring.registry_cas_apply(spark.createDataFrame(rows, RING_INSTANCE), spark.createDataFrame(shuffled, CHANGES), now)
    table, lost = plain_registry(rows, changes, now)
    assert {(r.app, r.dc, r.id): (r.instance_id, r.token, r.updated_ms) for r in after.collect()} == table
    assert sorted(r.seq for r in refused.collect()) == lost and 0 < len(lost) < len(changes)
    assert table["a", "d", 99] == ("z", "3", now)
    none = ring.registry_cas_apply(spark.createDataFrame([], RING_INSTANCE), spark.createDataFrame([], CHANGES), now)
    assert none[0].count() == none[1].count() == 0


def test_rounds_look_at_the_newest_first(spark):
    draw = random.Random(17)
    rows, good, paid = [], set(), set()
    for token in map(str, range(20)):
        for at in range(draw.randint(1, 12)):
            path = f"m{token}-{at}"
            rows.append(("c", token, at, path, path if draw.random() < 0.1 else None))
            if draw.random() < 0.3:
                good.add(path)
    looked = []

    def verdicts_of(asked):
        paths = [r.manifest_path for r in asked.collect()]
        looked.append(paths)
        return asked.withColumn("valid", F.col("manifest_path").isin(sorted(good)))

    candidates = spark.createDataFrame(rows, "cluster string, token string, snapshot_ms long, manifest_path string, seen string")
    found = {r.token: (r.manifest_path, r.valid, r.round) for r in verify.newest_valid_in_rounds(candidates, verdicts_of, "seen IS NOT NULL").collect()}
    total = 0
    for token in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == token), key=lambda r: -r[2])
        holds = [r for r in own if r[3] in good or r[4]]
        assert (found[token][0] if token in found else None) == (holds[0][3] if holds else None)
        depth = own.index(holds[0]) + 1 if holds else len(own)
        size = next(2**k - 1 for k in range(1, 9) if 2**k > depth)
        total += sum(r[4] is None for r in own[:size])
    assert sum(map(len, looked)) == total < len(rows)
    assert verify.newest_valid_in_rounds(candidates.limit(0), verdicts_of).count() == 0


def test_no_rate_without_a_target(spark):
    transfers = spark.createDataFrame([("n", 0, 1, 0, True, 9000, 2), ("n", 0, 2, 3000, True, 9000, 2)], "node string, ts_ms long, seq long, target_ms long, in_snapshot boolean, total_bytes long, threads int")
    assert {r.seq: r.wanted_rate for r in pacing.wanted_rates(transfers).collect()} == {1: None, 2: 1500.0}


def test_chunk_plan(spark):
    sizes = [0, 4095, 4096, 5000, 8192]
    plan = chunks.chunk_plan(spark.createDataFrame([(s, s) for s in sizes], "key long, size long"), 4096)
    parts = {}
    for r in plan.orderBy("key", "part_no").collect():
        parts.setdefault(r.key, []).append(r.part_size)
    assert parts == {0: [0], 4095: [4095], 4096: [4096, 0], 5000: [4096, 904], 8192: [4096, 4096, 0]}
    big = chunks.chunk_plan(spark.createDataFrame([(1, 10**12)], "key long, size long"))
    assert big.count() <= 9996 and big.agg(F.sum("part_size")).first()[0] == 10**12


def test_settings(spark):
    value = F.col("v")
    rows = spark.createDataFrame([("7",), (" 7",), ("x",), (None,), ("TRUE",), (" a, b ,,",)], "v string")
    found = rows.select(V.as_number(value, "int", 3).alias("n"), V.as_flag(value, True).alias("f"), V.as_list(value).alias("l")).collect()
    assert [r.n for r in found] == [7, 3, 3, 3, 3, 3]
    assert [r.f for r in found] == [False, False, False, True, True, False]
    assert found[5].l == ["a", "b"]
    layers = spark.createDataFrame([("a", "n", "p", None, 0), ("a", "n", "p", "x", 1), ("a", "n", "p", "y", 2)], "app string, node string, property string, value string, priority int")
    assert V.effective_config(layers).first().value == "x"
    zones = [("a", "p", "c1", "", 1), ("a", "p", "c2", None, 2), ("a", "q", "c", "", 3), ("a", "q", "r1", "here", 4), ("a", "q", "r2", "here", 5), ("a", "z", "no", "there", 6)]
    picked = sources.scan_config_region(spark.createDataFrame(zones, "app string, property string, value string, region string, seq int"), "here")
    assert {r.property: r.value for r in picked.collect()} == {"p": "c1", "q": "r2"}
    assert sources.app_of_group("store-east--1") == "store" and sources.app_of_group("-x") == "-x"


def test_health_rule(spark):
    names = health.FLAGS
    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(60):
        flags = {n: rng.random() < 0.8 for n in names}
        rows += [(str(i), n, v, 1, k) for k, (n, v) in enumerate(flags.items())] + [(str(i), "alive", not flags["alive"], 0, 99)]
        parts = all(flags[n] for n in ("alive", "directories", "gossip", "yml_written", "healthy_override"))
        expected[str(i)] = flags["restoring"] or (parts and (flags["thrift"] or flags["native"]))
    found = health.health_status(spark.createDataFrame(rows, "node string, flag string, value boolean, ts_ms long, seq long"))
    assert {r.node: r.healthy for r in found.collect()} == expected


def test_compaction_and_flush_targets(spark):
    draw = random.Random(23)
    owned = {(k, t) for k in ("sales", "stock", "plans") for t in ("day", "week", "year")}
    tables = spark.createDataFrame([("a", k, t) for k, t in [*owned, ("system", "peers"), ("SYSTEM_TRACES", "events")]], "app string, keyspace string, column_family string")

    def listed(text, k, t):
        return any(e in (f"{k}.*", f"{k}.{t}") for e in text.split(","))

    for _ in range(6):
        inc, exc = (draw.choice([None, "sales.*", "sales.day,stock.*", "plans.year", "system.*,stock.week"]) for _ in range(2))
        expected = {(k, t) for k, t in owned if (not inc or listed(inc, k, t)) and not (exc and listed(exc, k, t))}
        assert {(r.keyspace, r.column_family) for r in admin.compaction_targets(tables, inc, exc).collect()} == expected
    asked = spark.createDataFrame([("a", "stock"), ("a", "gone"), ("a", "system"), ("b", "stock")], "app string, keyspace string")
    assert {(r.app, r.keyspace, r.error) for r in admin.flush_targets(tables, asked).collect()} == {("a", "stock", None), ("a", "gone", "no_such_keyspace"), ("b", "stock", "no_such_keyspace")}
    assert {r.keyspace for r in admin.flush_targets(tables).collect()} == {"sales", "stock", "plans"}


def test_compaction_progress_and_histograms(spark):
    shares = [(0, 0), (0, 7), (7, 7), (1, 3), (2, 3), (1, 800), (3, 800), (5, 800), (10**12, 3 * 10**12)]
    shown = [r.progress for r in admin.compaction_progress(spark.createDataFrame(shares, "bytes_complete long, total_bytes long")).collect()]
    exact = [None if not t else (Decimal(c) * 100 / Decimal(t)).quantize(Decimal("0.01"), ROUND_HALF_EVEN) for c, t in shares]
    assert shown == ["n/a" if e is None else f"{e}%" for e in exact]
    offsets = admin.histogram_offsets()
    assert len(offsets) == 90 and offsets == sorted(set(offsets)) and admin.histogram_offsets(8) == list(range(1, 9))


def test_notification_types():
    assert notify.included_types("SST_V2, nope ,META") == ["META", "SST_V2"]
    assert notify.included_types("nope") == [] and notify.included_types(None) == []
