"""Ring registry: token ownership, slots, seeds and conditional changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapops.constants import DEAD_SUFFIX, MINUTE_MS, NEW_SLOT
from snapops.functions.text import region_offset
from snapops.functions.tokens import RANDOM, next_token, slot_token, sort_key
from snapops.operators.nearest import key_positions, token_bounds


def initial_token(slots: DataFrame, partitioner: str = RANDOM) -> DataFrame:
    """Token of every ``(size, position, region)`` slot; impossible slots carry an error.

    A column ``token_offset`` replaces the offset derived from the region.
    """
    if "token_offset" not in slots.columns:
        slots = slots.withColumn("token_offset", region_offset(F.col("region")))
    token = slot_token(F.col("size"), F.col("position"), F.col("token_offset"), partitioner)
    error = (
        F.when(F.col("size") <= 0, "size")
        .when(F.col("token_offset") < 0, "offset")
        .when(F.col("position") < 0, "position")
    )
    return slots.withColumns({"token": token, "error": error})


def dead_tokens(ring: DataFrame, live: DataFrame) -> DataFrame:
    """Registry rows whose instance is gone, and the one each rack's next node takes first.

    Tokens somebody owned come before slots prepared ahead of time, then the lowest id. The
    choice is an aggregate joined back, so a large rack is not sorted in one task.
    """
    dead = ring.join(live.select("instance_id").distinct(), "instance_id", "left_anti").withColumn(
        "pregenerated", F.col("instance_id") == NEW_SLOT
    )
    rank = F.struct("pregenerated", "id", "dc")
    first = dead.groupBy("app", "rack").agg(F.min(rank).alias("first"))
    return dead.join(first, ["app", "rack"]).withColumn("next_claim", rank == F.col("first")).drop("first")


def claims(claimants: DataFrame, dead: DataFrame, decisions: DataFrame) -> DataFrame:
    """Token each new node takes over: ``(app, rack, instance_id, dc, id, token, replace_ip, source)``.

    ``claimants(app, rack, instance_id)`` are numbered within their rack, and so are the
    offers: first the dead tokens with an address to replace, lowest id first, then the slots
    prepared ahead. The n-th claimant takes the n-th offer, so no token is given twice. A
    token whose owner the others see alive, or disagree about, is no offer; a claimant beyond
    the offers must generate a token (``source`` null). ``decisions(app, dc, token,
    replace_ip)`` as ``replace_ip_existing`` gives them.

    Numbers are counted in ranges of a rack, so a rack with most of the nodes is many tasks.
    """
    rack = ["app", "rack"]
    known = dead.join(decisions.select("app", "dc", "token", "replace_ip"), ["app", "dc", "token"], "left")
    offered = known.filter(F.col("pregenerated") | F.col("replace_ip").isNotNull())
    order = F.concat(F.when(F.col("pregenerated"), "1").otherwise("0"), F.lpad(F.col("id").cast("string"), 20, "0"), F.lit("/"), "dc")
    source = F.when(F.col("pregenerated"), "slot").otherwise("dead")
    offer = F.struct("dc", "id", "token", F.when(~F.col("pregenerated"), F.col("replace_ip")).alias("replace_ip"), source.alias("source"))
    offers = key_positions(offered.select(*rack, order.alias("key"), offer.alias("offer")), rack).select(*rack, "position", "offer")
    asking = claimants.select(*rack, "instance_id").distinct().withColumn("key", F.col("instance_id"))
    asking = key_positions(asking, rack).select(*rack, "instance_id", "position")
    return asking.join(offers, [*rack, "position"], "left").select(*rack, "instance_id", "offer.*")


def preassigned_tokens(instances: DataFrame, ring: DataFrame) -> DataFrame:
    """Row each ``(app, instance_id)`` already owns: in the dead registry first, else the live one."""
    row = F.struct("id", "token", "dc")
    owned = ring.groupBy("app", "instance_id").agg(F.min_by(row, F.struct("id", "dc")).alias("row"))
    is_dead = F.col("app").endswith(DEAD_SUFFIX)
    base = F.expr(f"substr(app, 1, length(app) - {len(DEAD_SUFFIX)})")
    dead = owned.filter(is_dead).select(base.alias("app"), "instance_id", F.col("row").alias("dead"))
    live = owned.filter(~is_dead).select("app", "instance_id", F.col("row").alias("live"))
    keys = ["app", "instance_id"]
    found = instances.join(dead, keys, "left").join(live, keys, "left")
    return found.select(
        *keys,
        F.coalesce("dead", "live")["id"].alias("id"),
        F.coalesce("dead", "live")["token"].alias("token"),
        F.coalesce("dead", "live")["dc"].alias("dc"),
        F.col("dead").isNotNull().alias("out_of_service"),
    )


def new_token_slot(requests: DataFrame, ring: DataFrame, partitioner: str = RANDOM) -> DataFrame:
    """Slot, id and token of each new node.

    ``requests(app, rack, dc, rack_index, n_racks, rack_size)``. The slot follows the highest
    id of the rack, or is the rack's index when the rack is empty. A token another dc already
    owns moves up to the end of its run of taken tokens; one the own dc owns is an error.
    """
    offset = region_offset(F.col("dc"))
    highest = ring.groupBy("app", "rack").agg(F.max("id").alias("max_id"))
    slot = F.when(
        F.col("max_id").isNotNull(),
        F.col("n_racks") + F.greatest("max_id", "token_offset") - F.col("token_offset"),
    ).otherwise(F.col("rack_index"))
    planned = (
        requests.withColumn("token_offset", offset)
        .join(highest, ["app", "rack"], "left")
        .withColumn("slot", slot)
        .withColumn(
            "token",
            slot_token(
                F.col("n_racks") * F.col("rack_size"), F.col("slot"), F.col("token_offset"), partitioner
            ),
        )
    )
    # the owner that is met first when several rows hold a token is the one with the lowest id
    owners = ring.groupBy("app", "token").agg(F.min_by("dc", F.struct("id", "dc")).alias("owner"))
    taken = owners.select("app", "token")
    followed = taken.select("app", "token", next_token(F.col("token")).alias("following"))
    run_ends = followed.join(
        taken.select("app", F.col("token").alias("following")), ["app", "following"], "left_anti"
    ).select("app", "token")
    colliding = planned.select("app", "token", "dc").join(taken, ["app", "token"], "left_semi").distinct()
    ends = token_bounds(colliding, run_ends, ["app"]).select("app", "token", F.col("higher").alias("run_end"))
    own = owners.withColumnRenamed("owner", "dc")
    own_next = token_bounds(colliding, own, ["app", "dc"]).select(
        "app", "dc", "token", F.col("higher").alias("own_next")
    )
    joined = planned.join(ends, ["app", "token"], "left").join(own_next, ["app", "dc", "token"], "left")
    blocked = sort_key(F.col("own_next")) <= sort_key(F.col("run_end"))
    error = F.when(F.col("slot").isNull(), "unknown_rack").when(blocked, "duplicate_in_dc")
    final = F.when(F.col("run_end").isNull(), F.col("token")).otherwise(next_token(F.col("run_end")))
    return joined.withColumn("error", error).select(
        "app",
        "rack",
        "dc",
        "slot",
        F.when(F.col("error").isNull(), F.col("slot") + F.col("token_offset")).alias("id"),
        F.when(F.col("error").isNull(), final).alias("token"),
        "error",
    )


def double_ring(ring: DataFrame, partitioner: str = RANDOM) -> DataFrame:
    """Registry of every (app, dc) at twice its size.

    Rows move to twice their slot; each is followed, three slots on, by a prepared slot.
    """
    dc = ["app", "dc"]
    sizes = ring.groupBy(*dc).agg((F.count(F.lit(1)) * 2).alias("new_size"))
    offset = region_offset(F.col("dc"))
    moved = ring.join(sizes, dc).withColumn("token_offset", offset)
    moved = moved.withColumn("slot", (F.col("id") - F.col("token_offset")) * 2)
    ahead = F.col("slot") + 3
    wrapped = F.when(ahead > F.col("new_size"), ahead - F.col("new_size")).otherwise(ahead)
    columns = ["app", "dc", "id", "instance_id", "rack", "token"]
    existing = moved.withColumn("id", F.col("slot") + F.col("token_offset")).select(*columns)
    added = (
        moved.withColumn("slot", wrapped)
        .withColumns(
            {
                "id": F.col("slot") + F.col("token_offset"),
                "instance_id": F.lit(NEW_SLOT),
                "token": slot_token(F.col("new_size"), F.col("slot"), F.col("token_offset"), partitioner),
            }
        )
        .select(*columns)
    )
    return existing.unionByName(added)


def _rack_heads(ring: DataFrame) -> DataFrame:
    """Per rack the two lowest ids of real instances on different hosts."""
    real = ring.filter(F.lower("instance_id") != NEW_SLOT)
    hosts = real.groupBy("app", "rack", "hostname").agg(F.min(F.struct("id", "dc", "ip")).alias("row"))
    order = Window.partitionBy("app", "rack").orderBy("row")
    heads = hosts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
    entry = F.struct("hostname", F.col("row.ip").alias("ip"))
    return heads.groupBy("app", "rack").agg(
        F.max(F.when(F.col("rank") == 1, entry)).alias("first"),
        F.max(F.when(F.col("rank") == 2, entry)).alias("second"),
    )


def seeds(
    ring: DataFrame, group_sizes: DataFrame | None = None, multi_dc: bool = False
) -> DataFrame:
    """One row per node and seed: the first real instance of each rack that is not the node itself.

    Only two candidates per rack are needed for that, so nodes meet racks, not each other.
    An application with a single rack has no seeds until its registry is as large as its
    group (``group_sizes(app, rack, max_size)``), and its first node also gets the second.
    """
    heads = _rack_heads(ring)
    nodes = ring.select("app", "dc", "id", F.col("rack").alias("my_rack"), "hostname", "ip")
    value = "ip" if multi_dc else "hostname"
    other = F.when(F.col("first.hostname") != F.col("hostname"), F.col("first")).otherwise(F.col("second"))
    met = nodes.join(heads.withColumnRenamed("rack", "seed_rack"), "app").withColumn("seed", other)
    out = ["app", "dc", "id", "seed_rack", "seed"]
    regular = met.filter(F.col("seed").isNotNull()).select("app", "dc", "id", "seed_rack", F.col(f"seed.{value}").alias("seed"))
    if group_sizes is None:
        return regular

    racks = ring.groupBy("app").agg(F.count_distinct("rack").alias("n_racks"))
    sizes = ring.groupBy("app", "rack").agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy("app", "rack").orderBy("id", "dc")
    ranked = ring.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
    row = F.struct("hostname", "ip", "instance_id")
    leaders = ranked.groupBy("app", "rack").agg(
        F.max(F.when(F.col("rank") == 1, row)).alias("lead"),
        F.max(F.when(F.col("rank") == 2, row)).alias("next"),
    )
    single = (
        sizes.join(racks.filter(F.col("n_racks") == 1), "app")
        .join(group_sizes.groupBy("app", "rack").agg(F.sum("max_size").alias("max_size")), ["app", "rack"], "left")
        .join(leaders, ["app", "rack"])
    )
    incomplete = single.filter(~F.col("n_rows").eqNullSafe(F.col("max_size"))).select("app")
    complete = single.filter(F.col("n_rows") == F.col("max_size")).select(
        "app", F.col("rack").alias("seed_rack"), "lead", "next"
    )
    extra = (
        nodes.join(complete, "app")
        .filter((F.col("lead.ip") == F.col("ip")) & (F.col("next.instance_id") != NEW_SLOT))
        .select("app", "dc", "id", "seed_rack", F.col(f"next.{value}").alias("seed"))
    )
    return regular.join(incomplete, "app", "left_anti").select(*out).unionByName(extra)


def is_seed(ring: DataFrame) -> DataFrame:
    """Whether a node runs on the host with the lowest id of its rack."""
    first = ring.groupBy("app", "rack").agg(
        F.min_by("hostname", F.struct("id", "dc")).alias("first_host")
    )
    return ring.join(first, ["app", "rack"]).select(
        "app", "dc", "id", (F.col("hostname") == F.col("first_host")).alias("is_seed")
    )


KEY = ["app", "dc", "id"]
FIELDS = ["instance_id", "hostname", "ip", "rack", "token"]
CHANGED = (
    "app string, dc string, id bigint, instance_id string, hostname string, ip string, rack string, token string, "
    "updated_ms bigint, seq bigint, op string, refused boolean"
)


def _folded(as_of_ms: int):
    """Plays the changes of each key in order on its row; rows come sorted, one row is held."""
    names = [c.split()[0] for c in CHANGED.split(", ")]
    oldest = as_of_ms - 3 * MINUTE_MS

    def passes(row: dict | None, change: dict) -> bool:
        if change["op"] == "update":
            return row is not None and (row["instance_id"], row["token"]) == (change["expected_instance"], change["expected_token"])
        if change["op"] == "create":
            return row is None or (row["app"].endswith(DEAD_SUFFIX) and row["updated_ms"] is not None and row["updated_ms"] < oldest)
        return change["op"] == "delete"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None
        out: list[dict] = []
        for batch in batches:
            for change in batch.to_pylist():
                here = tuple(change[k] for k in KEY)
                if here != key:
                    if row is not None:
                        out.append(row | {"seq": None, "op": None, "refused": False})
                    key, row = here, None
                now = {c: change[c] for c in (*KEY, *FIELDS)}
                if change["seq"] is None:
                    row = now | {"updated_ms": change["updated_ms"]}
                elif not passes(row, change):
                    out.append(now | {"updated_ms": None, "seq": change["seq"], "op": change["op"], "refused": True})
                else:
                    row = None if change["op"] == "delete" else now | {"updated_ms": as_of_ms}
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=_ARROW)
            out = []
        if row is not None:
            yield pa.RecordBatch.from_pylist([row | {"seq": None, "op": None, "refused": False}], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in CHANGED.split(", "))]
)


def registry_cas_apply(
    registry: DataFrame, changes: DataFrame, as_of_ms: int
) -> tuple[DataFrame, DataFrame]:
    """Registry after conditional changes in the order of ``seq``, and the changes that were refused.

    ``changes(seq, op, app, dc, id, expected_instance, expected_token, instance_id, hostname,
    ip, rack, token)`` with op ``update``, ``create`` or ``delete``. Each change of a key meets
    the row the one before it left: an update needs the expected instance and token, a create a
    free key (in a dead registry a row older than three minutes counts as free), a delete
    nothing. Equal numbers go in the order of op and instance.

    Rows and changes are hashed by key and sorted by number, and one row is held while a key's
    changes stream past, so a key with very many changes costs time, not memory.
    """
    nothing = {c: F.lit(None).cast("string") for c in ("expected_instance", "expected_token", "op")}
    current = registry.select(*KEY, *FIELDS, F.col("updated_ms").cast("bigint").alias("updated_ms")).withColumns({**nothing, "seq": F.lit(None).cast("bigint")})
    asked = changes.select("seq", "op", *KEY, *FIELDS, "expected_instance", "expected_token").withColumn("updated_ms", F.lit(None).cast("bigint"))
    rows = current.unionByName(asked).repartition(*KEY).sortWithinPartitions(*KEY, F.asc_nulls_first("seq"), "op", "instance_id")
    played = rows.mapInArrow(_folded(as_of_ms), CHANGED)
    after = played.filter("NOT refused").select(*KEY, *FIELDS, "updated_ms")
    refused = played.filter("refused").select("seq", "op", *KEY, F.lit("condition_failed").alias("reason"))
    return after, refused


def rack_capacity(groups: DataFrame) -> DataFrame:
    """Seats and racks of each application."""
    return groups.groupBy("app").agg(
        F.sum("max_size").alias("capacity"), F.count_distinct("rack").alias("racks")
    )
