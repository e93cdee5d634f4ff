import random

import pytest

from pyspark.sql import functions as F

from snapops.functions import text, tokens
from snapops.operators import nearest
from snapops.operators.nearest import closest_token, ring_position
from snapops.ranges import DateRange, parse_instant_ms


def plain_hash(value):
    raw, total = value.encode("utf-16-be"), 0
    for i in range(0, len(raw), 2):
        total = (total * 31 + raw[i] * 256 + raw[i + 1]) % 2**32
    return total - 2**32 if total >= 2**31 else total


def test_string_hash(spark):
    words = ["", "us-east-1", "app_with_underscore", "日本", "😀x", "z" * 60]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", text.string_hash(F.col("w")).alias("h"), text.region_offset(F.col("w")).alias("o")
    )
    found = {r.w: (r.h, r.o) for r in rows.collect()}
    assert {w: h for w, (h, _) in found.items()} == {w: plain_hash(w) for w in words}
    assert found["us-east-1"][1] == 1808575600


def test_instants(spark):
    texts = ["201801011201", "20180101", "2018", "201813011201", "2018-0101", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.instant_ms(F.col("t")).alias("ms"))
    assert [r.ms for r in rows.collect()] == [1514808060000, 1514764800000] + [None] * 5
    assert parse_instant_ms("201801011201") == 1514808060000
    assert parse_instant_ms("201813011201") is None


def test_date_range():
    assert DateRange.parse("default", 1_000_000_000) == DateRange(913_600_000, 1_000_000_000)
    assert DateRange.parse(" ", 86_400_000) == DateRange(0, 86_400_000)
    assert DateRange.parse("201801011201,20180102", 0) == DateRange(1514808060000, 1514851200000)


def test_token_arithmetic(spark):
    rng = random.Random(7)
    edges = [0, 1, -1, 2**63, -(2**63), 2**127, 10**20 - 1, 2 * 10**20 - 1, 10**38 - 1]
    values = edges + [rng.randint(-(2**63), 2**63) for _ in range(50)] + [rng.randint(0, 2**127) for _ in range(50)]
    rows = []
    for value in values:
        low = value - rng.choice([0, 1, 5, rng.randint(0, 2**60)])
        high = value + rng.choice([0, 1, 5, value - low])
        rows.append((str(value), str(low), str(high)))
    t, lo, hi = F.col("t"), F.col("l"), F.col("h")
    found = (
        spark.createDataFrame(rows, "t string, l string, h string")
        .select(
            "*",
            tokens.sort_key(t).alias("key"),
            tokens.token_of(tokens.sort_key(t)).alias("back"),
            tokens.nearer_is_lower(t, lo, hi).alias("lower"),
            tokens.next_token(t).alias("following"),
        )
        .collect()
    )
    for row in found:
        assert row.back == row.t
        assert row.following == str(int(row.t) + 1)
        assert row.lower == (int(row.h) - int(row.t) > int(row.t) - int(row.l))
    by_key = sorted(found, key=lambda r: r.key)
    assert [int(r.t) for r in by_key] == sorted(int(r.t) for r in found)


def test_slot_tokens(spark):
    slots = [(1, 0, 0), (1, 1, 7), (3, 2, 11), (7, 6, 1808575600), (2**31 - 1, 2**31 - 2, 5), (0, 1, 1), (3, -1, 0), (3, 1, -1)]
    size, position, offset = F.col("s"), F.col("p"), F.col("o")
    rows = (
        spark.createDataFrame(slots, "s long, p long, o long")
        .select(
            "*",
            tokens.slot_token(size, position, offset, tokens.RANDOM).alias("r"),
            tokens.slot_token(size, position, offset, tokens.MURMUR3).alias("m"),
        )
        .collect()
    )
    for row in rows:
        good = row.s > 0 and row.p >= 0 and row.o >= 0
        assert row.r == (str(2**127 // row.s * row.p + row.o) if good else None)
        assert row.m == (str(2**64 // row.s * row.p + row.o - 2**63) if good else None)


def brute_closest(token, ring):
    return min(ring, key=lambda r: (abs(r - token), -r))


@pytest.mark.parametrize("per_range", [64, 3])
def test_closest_token_against_brute_force(spark, monkeypatch, per_range):
    monkeypatch.setattr(nearest, "PER_RANGE", per_range)
    rng = random.Random(3)
    ring = [rng.randint(-(2**63), 2**63) for _ in range(40)] + [rng.randint(0, 2**127) for _ in range(40)] + [10, 12, 2**127]
    asked = ring[:5] + [11, 0, -(2**63), 2**127] + [rng.randint(-(2**63), 2**127) for _ in range(100)]
    wanted = spark.createDataFrame([("a", str(t)) for t in asked] + [("none", "5")], "app string, token string")
    owned = spark.createDataFrame([("a", str(t)) for t in ring], "app string, token string")
    for row in closest_token(wanted, owned, ["app"]).collect():
        if row.app == "none":
            assert row.closest is None and row.error == "empty_ring"
        else:
            assert row.closest == str(brute_closest(int(row.token), ring))


@pytest.mark.parametrize("per_range", [64, 3])
def test_ring_position_counts_smaller_tokens(spark, monkeypatch, per_range):
    monkeypatch.setattr(nearest, "PER_RANGE", per_range)
    rng = random.Random(4)
    values = [rng.randint(-(2**63), 2**63) for _ in range(60)] + [5, 5, 6]
    ring = spark.createDataFrame([("a", i, str(t)) for i, t in enumerate(values)], "app string, id long, token string")
    for row in ring_position(ring, ["app"]).collect():
        assert row.position == sum(v < int(row.token) for v in values)
        assert row.ring_size == len(values)


def test_crowded_rings_spread_over_all_ranges(spark):
    start = 2**126 + 12_345
    narrow = spark.range(40_000).select(F.lit("narrow").alias("app"), F.concat(F.lit(str(start)[:-6]), F.lpad((F.col("id") + 100_000).cast("string"), 6, "0")).alias("token"))
    wide = spark.range(3000).select(F.lit("wide").alias("app"), (F.col("id") * 2**50 - 2**61).cast("string").alias("token"))
    small = spark.range(5).select(F.lit("small").alias("app"), F.col("id").cast("string").alias("token"))
    keyed = nearest._keyed(narrow.unionByName(wide).unionByName(small), ["app"])
    ranged = nearest.with_ranges(keyed, nearest.ring_cuts(keyed, ["app"]), ["app"])
    sizes = {}
    for r in ranged.groupBy("app", "range").count().collect():
        sizes.setdefault(r.app, {})[r.range] = r["count"]
    for app, n in (("narrow", 40_000), ("wide", 3000), ("small", 5)):
        found = sizes[app]
        assert sorted(found) == list(range(len(found))) and sum(found.values()) == n
        assert max(found.values()) <= 3 * n / len(found)
    assert len(sizes["narrow"]) >= 200 and len(sizes["wide"]) >= 30 and len(sizes["small"]) == 1
    edges = ranged.groupBy("app", "range").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("app", "range").collect()
    assert all(a.high < b.low for a, b in zip(edges, edges[1:]) if a.app == b.app)
