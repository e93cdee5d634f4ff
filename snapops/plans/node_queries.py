"""Queries over local files, uploads, rings, gossip, settings, health and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.functions.text import region_offset
from snapops.functions.tokens import MURMUR3, slot_token
from snapops.operators import admin, chunks, filters, gossip, health, nearest, notify, orphans, pacing, transfer, uploads, verify
from snapops.operators import ring as R
from snapops.operators import settings as V
from snapops.plans import tables as T
from snapops.plans.catalog_queries import AS_OF, CHECKED, SPAN, catalog_v2, run_records, run_verdicts
from snapops.plans.registry import query
from snapops.plans.tables import sql_minute
from snapops.session import shared_dir
from snapops.sources import gossip_dump, registry
from snapops.sources import listing as L
from snapops.sources import settings as sources

DAY = T.DAY

# --- local files ----------------------------------------------------------------------------


@query(
    "scan_data_dir",
    "inv",
    f"""SELECT cluster, token, local_path, keyspace, column_family, CASE kind WHEN 0 THEN 'snapshots' WHEN 1 THEN 'backups' END AS folder,
        CASE WHEN kind = 0 THEN {sql_minute('last_modified_ms')} END AS snapshot_name, file_name, size FROM inv""",
)
def scan_data_dir(spark, sf):
    files = L.scan_data_dir(T.inventory(spark, sf), "/data")
    return files.select(
        "cluster", "token", "local_path", "keyspace", "column_family", "folder", "snapshot_name", "file_name", "size"
    )


@T.shared_plan
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.build_upload_table(T.inventory(spark, sf), "/data", "backup", "SST_V2")


@query(
    "scan_file_tree",
    "inv",
    "SELECT keyspace, column_family, folder, count(*) AS n_files, bool_and(size > 0) AS all_have_bytes FROM (SELECT DISTINCT keyspace, column_family, "
    "CASE kind WHEN 0 THEN 'snapshots' WHEN 1 THEN 'backups' END AS folder, 1 AS size FROM inv WHERE kind < 2) GROUP BY 1, 2, 3",
)
def scan_file_tree(spark, sf):
    """Files below a data folder, listed by a file scan that reads no content: one for each table and folder."""
    path = shared_dir(spark, "data-dir")
    rows = L.scan_data_dir(T.inventory(spark, sf), "/data").filter("folder IS NOT NULL").select("keyspace", "column_family", "folder", "file_name")
    keys = ["keyspace", "column_family", "folder"]
    rows.repartition(*keys).write.partitionBy(*keys).json(path)
    tree = L.read_file_tree(spark, path)
    named = tree.withColumn("local_path", F.regexp_replace(F.expr("substr(remote_path, instr(remote_path, '/keyspace='))"), "/[a-z_]+=", "/"))
    # the folder lies beside the file, so a snapshot needs a name to be told from it
    named = named.withColumn("local_path", F.regexp_replace("local_path", "/snapshots/", "/snapshots/s/"))
    found = L.scan_data_dir(named, "/")
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.bool_and(F.col("size") > 0).alias("all_have_bytes"))


@query(
    "build_upload_table",
    "inv clusters",
    """SELECT cluster, token, local_path, keyspace, table_dir AS column_family, regexp_extract(file_name, '^(.*)-[^-]*$', 1) AS prefix, kind = 1 AS is_incremental,
        last_modified_ms, 'backup/' || hashed || '/' || token || '/SST_V2/' || last_modified_ms || '/' || keyspace || '/' || table_dir ||
        '/SNAPPY/PLAINTEXT/' || file_name AS remote_path FROM inv JOIN clusters USING (cluster)""",
)
def build_upload_table(spark, sf):
    return candidates(spark, sf).select(
        "cluster", "token", "local_path", "keyspace", "column_family", "prefix", "is_incremental", "last_modified_ms", "remote_path"
    )


@query(
    "log_and_manifest_uploads",
    "v1 man",
    """SELECT cluster, token, 'CL' AS file_type, '/commitlog/' || file_name AS local_path, remote_path FROM v1 WHERE file_type = 'CL'
        UNION ALL SELECT cluster, token, 'META_V2', '/data/' || regexp_extract(manifest_path, '[^/]*$'), manifest_path FROM man""",
)
def log_and_manifest_uploads(spark, sf):
    table = uploads.build_log_and_manifest_uploads(T.node_files(spark, sf), "/data", "/commitlog", "backup")
    return table.select("cluster", "token", "file_type", "local_path", "remote_path")


TRANSITION = 852_076_800_000


@query(
    "compression_choice",
    "inv",
    f"""SELECT cluster, token, local_path, last_modified_ms, CASE WHEN last_modified_ms < {TRANSITION} THEN 'SNAPPY'
        WHEN bool_or(file_name LIKE '%-CompressionInfo.db') OVER (PARTITION BY cluster, token, regexp_extract(local_path, '^(.*)/[^/]*$', 1),
            regexp_extract(file_name, '^(.*)-[^-]*$', 1)) THEN 'NONE' ELSE 'SNAPPY' END AS compression FROM inv""",
)
def compression_choice(spark, sf):
    chosen = uploads.compression_choice(candidates(spark, sf), "IF_REQUIRED", TRANSITION)
    return chosen.select("cluster", "token", "local_path", "last_modified_ms", "compression")


@query(
    "upload_order",
    "inv",
    "SELECT cluster, token, local_path, CASE WHEN local_path LIKE '%-Data.db' THEN 1 ELSE 0 END::BIGINT AS upload_pass FROM inv",
)
def upload_order(spark, sf):
    ordered = uploads.upload_order(candidates(spark, sf))
    return ordered.select("cluster", "token", "local_path", F.col("upload_pass").cast("bigint").alias("upload_pass"))


@query(
    "upload_todo",
    "obj inv",
    """SELECT DISTINCT cluster, token, local_path FROM inv JOIN obj USING (cluster, token, keyspace, column_family, file_name, last_modified_ms)
        WHERE min_orderkey % 4001 = 0""",
)
def upload_todo(spark, sf):
    plain = candidates(spark, sf).withColumn("column_family", F.substring_index("table_dir", "-", 1))
    todo = uploads.upload_todo(uploads.with_remote_path(plain), T.listing_v2(spark, sf))
    return todo.select("cluster", "token", "local_path")


@query(
    "upload_deadline",
    "run",
    f"""SELECT cluster, token, least({AS_OF} + 90 * 60000, max(start_ms) FILTER (last_validated_ms IS NOT NULL) + 86400000,
        max(start_ms) FILTER (version = 1) + 3600000) AS deadline_ms FROM run GROUP BY 1, 2""",
)
def upload_deadline(spark, sf):
    clusters = run_records(spark, sf).groupBy("cluster", "token").agg(
        F.max(F.when(F.col("last_validated_ms").isNotNull(), F.col("start_ms"))).alias("last_verified_ms"),
        (F.max(F.when(F.col("version") == 1, F.col("start_ms"))) + 3_600_000).alias("next_snapshot_ms"),
    )
    return uploads.upload_deadline(clusters, AS_OF, 90).select("cluster", "token", "deadline_ms")


@query(
    "snapshot_dir_size",
    "inv",
    "SELECT cluster, token, sum(size)::BIGINT AS snapshot_bytes FROM inv WHERE kind = 0 GROUP BY 1, 2",
)
def snapshot_dir_size(spark, sf):
    return uploads.snapshot_dir_size(T.inventory(spark, sf))


@query("drop_empty_incrementals", "inv", "SELECT cluster, token, local_path, size FROM inv WHERE kind = 1 AND size > 0")
def drop_empty_incrementals(spark, sf):
    files = L.scan_data_dir(T.inventory(spark, sf), "/data", "backups")
    return filters.drop_empty_incrementals(files).select("cluster", "token", "local_path", "size")


@T.shared_plan
def table_files(spark: SparkSession, sf: str) -> DataFrame:
    files = L.scan_data_dir(T.inventory(spark, sf), "/data")
    return files.filter(F.col("folder").isNull())


@query(
    "orphan_candidates",
    "inv",
    f"SELECT cluster, token, local_path, last_modified_ms FROM inv WHERE kind = 2 AND last_modified_ms <= {AS_OF} - 5 * {DAY}",
)
def orphan_candidates(spark, sf):
    found = filters.orphan_candidates(table_files(spark, sf), AS_OF)
    return found.select("cluster", "token", "local_path", F.col("modified_ms").alias("last_modified_ms"))


@T.shared_plan
def orphans_of(spark: SparkSession, sf: str) -> DataFrame:
    latest = T.entries(spark, sf).filter(F.col("snapshot_ms") == AS_OF)
    snapshot = latest.select("cluster", "token", "keyspace", "column_family", "file_name")
    return orphans.orphan_files(table_files(spark, sf), snapshot, AS_OF)


ORPHANS = f"""(SELECT i.* FROM inv i WHERE kind = 2 AND last_modified_ms <= {AS_OF} - 5 * {DAY} AND NOT EXISTS (
    SELECT 1 FROM ent e WHERE e.snapshot_ms = {AS_OF} AND e.cluster = i.cluster AND e.token = i.token AND e.keyspace = i.keyspace
    AND e.column_family = i.column_family AND e.file_name = i.file_name))"""


@query("orphan_files", "inv ent", f"SELECT cluster, token, keyspace, column_family, file_name, last_modified_ms FROM {ORPHANS}")
def orphan_files(spark, sf):
    return orphans_of(spark, sf).select(
        "cluster", "token", "keyspace", "column_family", "file_name", F.col("modified_ms").alias("last_modified_ms")
    )


@query(
    "orphan_lifecycle",
    "inv ent",
    f"""SELECT cluster, token, keyspace, column_family, file_name, action, marked_ms,
        CASE WHEN action IN ('LINK', 'WAIT', 'MOVE') THEN coalesce(marked_ms, {AS_OF}) END AS next_marked_ms FROM (
        SELECT cluster, token, keyspace, column_family, file_name, m.marked_ms, CASE WHEN NOT coalesce(orphan, FALSE) THEN 'UNLINK' WHEN marked_ms IS NULL THEN 'LINK'
            WHEN {AS_OF} > marked_ms + 3 * {DAY} THEN 'MOVE' ELSE 'WAIT' END AS action
        FROM (SELECT DISTINCT cluster, token, keyspace, column_family, file_name, TRUE AS orphan FROM {ORPHANS}) o
        FULL OUTER JOIN (SELECT cluster, token, keyspace, column_family, file_name, min({AS_OF} - size * 10000) AS marked_ms FROM inv WHERE size % 3 = 0
            GROUP BY 1, 2, 3, 4, 5) m
        USING (cluster, token, keyspace, column_family, file_name))""",
)
def orphan_lifecycle(spark, sf):
    files = L.scan_data_dir(T.inventory(spark, sf), "/data")
    markers = files.filter(F.col("size") % 3 == 0).withColumn("marked_ms", F.lit(AS_OF) - F.col("size") * 10_000)
    return orphans.orphan_lifecycle(orphans_of(spark, sf), markers, AS_OF).drop("moved")


# --- parts ----------------------------------------------------------------------------------

CHUNK = 4096
PARTS_SQL = f"""(SELECT d.*, unnest(range(CASE WHEN size < {CHUNK} THEN 1 ELSE size // step + 1 END)) AS n FROM (
    SELECT doc_id AS key, encode(text) AS content, octet_length(encode(text)) AS size,
    (greatest(octet_length(encode(text)) // 9995, {CHUNK}) + 2047) // 2048 * 2048 AS step FROM documents) d)"""
PART_SQL = f"content[n * step + 1 : CASE WHEN size < {CHUNK} THEN size ELSE n * step + step END]"


@T.shared_plan
def contents(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("content"))


@query(
    "chunk_plan",
    "",
    f"""SELECT key, size, n + 1 AS part_no, n * step AS part_offset, CASE WHEN size < {CHUNK} THEN size ELSE least(step, size - n * step) END AS part_size,
        size >= {CHUNK} AS multipart FROM {PARTS_SQL}""",
)
def chunk_plan(spark, sf):
    sizes = contents(spark, sf).select("key", F.octet_length("content").cast("bigint").alias("size"))
    return chunks.chunk_plan(sizes, CHUNK)


@query(
    "chunk_md5",
    "",
    f"""SELECT key, n + 1 AS part_no, octet_length({PART_SQL}) AS part_size, md5({PART_SQL}) AS md5_hex,
        base64(unhex(md5({PART_SQL}))) AS md5_base64 FROM {PARTS_SQL}""",
)
def chunk_md5(spark, sf):
    return chunks.chunk_md5(contents(spark, sf), CHUNK)


@query(
    "part_checksum_audit",
    "",
    f"""SELECT key, count(*) FILTER (n >= 0) AS parts_expected, count(*) FILTER (n < 0 OR (key + n) % 50 <> 0) AS parts_reported,
        count(*) FILTER (n >= 0 AND (key + n) % 50 <> 0 AND (key + n) % 70 = 0) AS wrong_tag,
        count(*) FILTER (n >= 0 AND (key + n) % 50 = 0) AS not_reported, count(*) FILTER (n < 0) AS not_expected,
        bool_and(n >= 0 AND (key + n) % 50 <> 0 AND (key + n) % 70 <> 0) AS complete
        FROM (SELECT key, n FROM {PARTS_SQL} UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id % 90 = 1) GROUP BY 1""",
)
def part_checksum_audit(spark, sf):
    expected = chunks.chunk_md5(contents(spark, sf), CHUNK)
    shift = F.col("key") + F.col("part_no") - 1
    reported = expected.filter(shift % 50 != 0).select(
        "key", "part_no", F.when(shift % 70 == 0, "wrong").otherwise(F.col("md5_hex")).alias("etag")
    )
    extra = contents(spark, sf).filter(F.col("key") % 90 == 1).select(
        "key", F.lit(0).cast("bigint").alias("part_no"), F.lit("extra").alias("etag")
    )
    return chunks.part_checksum_audit(expected, reported.unionByName(extra))


# --- ring -----------------------------------------------------------------------------------


@query(
    "scan_registry",
    "ring",
    "SELECT app, dc, id, instance_id, hostname, ip, rack, tok::VARCHAR AS token, updated_ms FROM ring WHERE app = 'app1'",
)
def scan_registry(spark, sf):
    return registry.scan_registry(T.ring(spark, sf), "app1")


RANDOM_TOKEN = "(170141183460469231731687303715884105728::UHUGEINT // {size}::UHUGEINT * {position}::UHUGEINT + {offset}::UHUGEINT)"
NAME_HASH = T._sql_hash("s_name")


def slots(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        key.alias("id"), (key % 13 * 10).alias("size"), (key * 7 % 11 - 1).alias("position"), F.col("s_name").alias("region")
    )


_BAD_SLOT = "CASE WHEN s_suppkey % 13 <= 0 THEN 'size' WHEN s_suppkey * 7 % 11 - 1 < 0 THEN 'position' END"


@query(
    "initial_token",
    "",
    f"""SELECT s_suppkey AS id, {_BAD_SLOT} AS error, CASE WHEN {_BAD_SLOT} IS NULL THEN
        {RANDOM_TOKEN.format(size='greatest(s_suppkey % 13 * 10, 1)', position='greatest(s_suppkey * 7 % 11 - 1, 0)', offset=f'abs({NAME_HASH})')}::VARCHAR END AS token
        FROM supplier""",
)
def initial_token(spark, sf):
    return R.initial_token(slots(spark, sf)).select("id", "error", "token")


@query(
    "initial_token_murmur3",
    "",
    f"""SELECT s_suppkey AS id, {_BAD_SLOT} AS error, CASE WHEN {_BAD_SLOT} IS NULL THEN
        (18446744073709551616::HUGEINT // greatest(s_suppkey % 13 * 10, 1)::HUGEINT * greatest(s_suppkey * 7 % 11 - 1, 0)::HUGEINT
        + abs({NAME_HASH})::HUGEINT - 9223372036854775808::HUGEINT)::VARCHAR END AS token FROM supplier""",
)
def initial_token_murmur3(spark, sf):
    return R.initial_token(slots(spark, sf), MURMUR3).select("id", "error", "token")


@query(
    "closest_token",
    "ring",
    """WITH q AS (SELECT 'app' || (c_custkey % 3) AS app, c_custkey::BIGINT AS id,
            (170141183460469231731687303715884105728::UHUGEINT // 150000000::UHUGEINT * (c_custkey * 7)::UHUGEINT) AS wanted FROM customer),
        lo AS (SELECT q.app, q.id, max(tok) AS lower FROM q JOIN ring r ON q.app = r.app AND tok <= wanted GROUP BY 1, 2),
        hi AS (SELECT q.app, q.id, min(tok) AS higher FROM q JOIN ring r ON q.app = r.app AND tok >= wanted GROUP BY 1, 2)
        SELECT app, id, wanted::VARCHAR AS token, (CASE WHEN lower IS NULL THEN higher WHEN higher IS NULL THEN lower
            WHEN wanted - lower < higher - wanted THEN lower ELSE higher END)::VARCHAR AS closest, NULL::VARCHAR AS error
        FROM q LEFT JOIN lo USING (app, id) LEFT JOIN hi USING (app, id)""",
)
def closest_token(spark, sf):
    key = F.col("c_custkey")
    wanted = T.table(spark, sf, "customer").select(
        F.concat(F.lit("app"), T.text(key % 3)).alias("app"),
        key.alias("id"),
        slot_token(F.lit(150_000_000), key * 7, F.lit(0)).alias("token"),
    )
    return nearest.closest_token(wanted, T.ring(spark, sf), ["app"])


@query(
    "ring_position",
    "ring",
    """SELECT app, dc, id, rank() OVER (PARTITION BY app ORDER BY tok) - 1 AS position, count(*) OVER (PARTITION BY app) AS ring_size FROM ring""",
)
def ring_position(spark, sf):
    return nearest.ring_position(T.ring(spark, sf), ["app"]).select("app", "dc", "id", "position", "ring_size")


@query(
    "new_token_slot",
    "ring",
    f"""WITH req AS (SELECT app, rack, dc, region_offset, max(id) AS dc_max, 3 AS n_racks, {T.RING_SLOTS} AS rack_size FROM ring GROUP BY 1, 2, 3, 4),
        top AS (SELECT app, rack, max(id) AS max_id FROM ring GROUP BY 1, 2),
        s AS (SELECT req.*, 3 + greatest(max_id, region_offset) - region_offset AS slot FROM req JOIN top USING (app, rack)),
        t AS (SELECT *, {RANDOM_TOKEN.format(size='(n_racks * rack_size)', position='slot', offset='region_offset')} AS tok FROM s)
        SELECT t.app, t.rack, t.dc, slot, CASE WHEN r.dc IS NULL THEN slot + region_offset END AS id, CASE WHEN r.dc IS NULL THEN t.tok::VARCHAR END AS token,
        CASE WHEN r.dc IS NOT NULL THEN 'duplicate_in_dc' END AS error FROM t LEFT JOIN (SELECT DISTINCT app, dc, tok FROM ring) r ON t.app = r.app AND t.dc = r.dc AND t.tok = r.tok""",
)
def new_token_slot(spark, sf):
    requests = T.ring(spark, sf).groupBy("app", "rack", "dc").agg(
        F.lit(0).cast("bigint").alias("rack_index"),
        F.lit(3).cast("bigint").alias("n_racks"),
        F.lit(T.RING_SLOTS).cast("bigint").alias("rack_size"),
    )
    return R.new_token_slot(requests, T.ring(spark, sf))


@query(
    "double_ring",
    "ring",
    f"""WITH m AS (SELECT *, (id - region_offset) * 2 AS slot, count(*) OVER (PARTITION BY app, dc) * 2 AS n FROM
            (SELECT app, dc, rack, instance_id, tok, region_offset, row_number() OVER (PARTITION BY app, dc ORDER BY tok) - 1 + region_offset AS id FROM ring)),
        a AS (SELECT *, CASE WHEN slot + 3 > n THEN slot + 3 - n ELSE slot + 3 END AS s FROM m)
        SELECT app, dc, slot + region_offset AS id, instance_id, rack, tok::VARCHAR AS token FROM m
        UNION ALL SELECT app, dc, s + region_offset, 'new_slot', rack, {RANDOM_TOKEN.format(size='n', position='s', offset='region_offset')}::VARCHAR FROM a""",
)
def double_ring(spark, sf):
    placed = nearest.ring_position(T.ring(spark, sf), ["app", "dc"])
    registered = placed.withColumn("id", F.col("position") + region_offset(F.col("dc")))
    return R.double_ring(registered)


@T.shared_plan
def members(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    state = F.when(key % 5 == 0, "Terminated").when(key % 7 == 0, "Shutting-Down").otherwise("InService")
    return T.table(spark, sf, "supplier").select(F.concat(F.lit("i-"), T.text(key)).alias("instance_id"), state.alias("state"))


LIVE = "(SELECT 'i-' || s_suppkey AS instance_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0)"


@query(
    "live_members",
    "",
    f"SELECT instance_id FROM {LIVE} UNION SELECT 'i-' || c_custkey FROM customer WHERE c_custkey % 6 <> 0",
)
def live_members(spark, sf):
    key = F.col("c_custkey")
    sibling = T.table(spark, sf, "customer").select(
        F.concat(F.lit("i-"), T.text(key)).alias("instance_id"),
        F.when(key % 6 == 0, "TERMINATING").otherwise("Pending").alias("state"),
    )
    return filters.live_members(members(spark, sf), sibling)


@query(
    "rack_capacity",
    "",
    "SELECT 'app' || (s_suppkey % 3) AS app, sum(s_suppkey % 10)::BIGINT AS capacity, count(DISTINCT s_nationkey % 3) AS racks FROM supplier GROUP BY 1",
)
def rack_capacity(spark, sf):
    key = F.col("s_suppkey")
    groups = T.table(spark, sf, "supplier").select(
        F.concat(F.lit("app"), T.text(key % 3)).alias("app"),
        (F.col("s_nationkey") % 3).alias("rack"),
        (key % 10).alias("max_size"),
    )
    return R.rack_capacity(groups)


DEAD = f"(SELECT *, instance_id = 'new_slot' AS pregenerated FROM ring WHERE instance_id NOT IN (SELECT instance_id FROM {LIVE}))"


@query(
    "dead_tokens",
    "ring",
    f"""SELECT app, rack, dc, id, pregenerated, row_number() OVER (PARTITION BY app, rack ORDER BY pregenerated, id, dc) = 1 AS next_claim FROM {DEAD}""",
)
def dead_tokens(spark, sf):
    live = filters.live_members(members(spark, sf))
    return R.dead_tokens(T.ring(spark, sf), live).select("app", "rack", "dc", "id", "pregenerated", "next_claim")


@query(
    "claims",
    "ring consensus",
    f"""WITH said AS (SELECT r.app, r.dc, r.id, status, x.ip, live FROM ring r JOIN consensus x ON x.app = 'app0' AND x.dc = 'dc0' AND x.token = r.id::VARCHAR),
        o AS (SELECT d.app, d.rack, d.dc, d.id, d.tok::VARCHAR AS token, pregenerated, CASE WHEN status = 'MISMATCH' OR (status = 'GOOD' AND live) THEN NULL
            WHEN status = 'GOOD' THEN c.ip ELSE d.ip END AS replace_ip FROM {DEAD} d LEFT JOIN said c USING (app, dc, id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY app, rack ORDER BY pregenerated, id, dc) AS n FROM o WHERE pregenerated OR replace_ip IS NOT NULL),
        a AS (SELECT app, rack, instance_id, row_number() OVER (PARTITION BY app, rack ORDER BY instance_id) AS n FROM
            (SELECT 'app' || (c_custkey % 3) AS app, 'r' || (c_nationkey % 3) AS rack, 'new-' || c_custkey AS instance_id FROM customer WHERE c_custkey % 40 = 1))
        SELECT a.app, a.rack, a.instance_id, n.dc, n.id, n.token, CASE WHEN NOT pregenerated THEN replace_ip END AS replace_ip,
        CASE WHEN pregenerated THEN 'slot' WHEN NOT pregenerated THEN 'dead' END AS source FROM a LEFT JOIN n USING (app, rack, n)""",
)
def claims(spark, sf):
    """New nodes take over dead tokens; gossip of app0 in dc0 about a token number tells on the instance of that id."""
    ring, key = T.ring(spark, sf), F.col("c_custkey")
    dead = R.dead_tokens(ring, filters.live_members(members(spark, sf)))
    heard = consensus(spark, sf).filter("app = 'app0' AND dc = 'dc0'").select(F.col("token").cast("bigint").alias("id"), "status", "ip", "live")
    said = ring.select("app", "dc", "token", "id").join(heard, "id").drop("id")
    decisions = gossip.replace_ip_existing(ring.select("app", "dc", "token", F.col("ip").alias("registry_ip")), said)
    asking = T.table(spark, sf, "customer").filter(key % 40 == 1).select(
        F.concat(F.lit("app"), T.text(key % 3)).alias("app"),
        F.concat(F.lit("r"), T.text(F.col("c_nationkey") % 3)).alias("rack"),
        F.concat(F.lit("new-"), T.text(key)).alias("instance_id"),
    )
    return R.claims(asking, dead, decisions)


@query(
    "preassigned_tokens",
    "ring",
    """SELECT i.app, i.instance_id, r.id, r.tok::VARCHAR AS token, r.dc, coalesce(r.id % 4 = 0, FALSE) AS out_of_service
        FROM (SELECT 'app' || (c_custkey % 3) AS app, 'i-' || c_custkey AS instance_id FROM customer) i
        LEFT JOIN ring r ON i.app = r.app AND i.instance_id = r.instance_id""",
)
def preassigned_tokens(spark, sf):
    key = F.col("c_custkey")
    instances = T.table(spark, sf, "customer").select(
        F.concat(F.lit("app"), T.text(key % 3)).alias("app"), F.concat(F.lit("i-"), T.text(key)).alias("instance_id")
    )
    ring = T.ring(spark, sf)
    retired = ring.filter(F.col("id") % 4 == 0).withColumn("app", F.concat("app", F.lit("-dead")))
    return R.preassigned_tokens(instances, ring.unionByName(retired))


@query(
    "registry_cas_apply",
    "ring",
    """SELECT app, dc, id, CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 'i-last' ELSE instance_id END AS instance_id, tok::VARCHAR AS token,
        CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 1000000000000 ELSE updated_ms END AS updated_ms FROM ring WHERE id % 3 <> 1
        UNION ALL SELECT app, dc, id + 1000000000, 'i-last', tok::VARCHAR, 1000000000000 FROM ring WHERE id % 3 = 2""",
)
def registry_cas_apply(spark, sf):
    return cas(spark, sf)[0].select("app", "dc", "id", "instance_id", "token", "updated_ms")


def cas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ring, key = T.ring(spark, sf), F.col("id")
    op = F.when(key % 3 == 0, "update").when(key % 3 == 1, "delete").otherwise("create")
    changes = ring.select(
        key.alias("seq"),
        op.alias("op"),
        "app",
        "dc",
        F.when(key % 3 == 2, key + 1_000_000_000).otherwise(key).alias("id"),
        F.when(key % 6 == 0, "someone-else").otherwise(F.col("instance_id")).alias("expected_instance"),
        F.col("token").alias("expected_token"),
        F.lit("i-new").alias("instance_id"),
        "hostname",
        "ip",
        "rack",
        "token",
    )
    late = changes.withColumn("seq", F.col("seq") + 2_000_000_000)
    builds_on = {"seq": F.col("seq") + 4_000_000_000, "op": F.lit("update"), "expected_instance": F.lit("i-new"), "instance_id": F.lit("i-last")}
    return R.registry_cas_apply(ring, changes.unionByName(late).unionByName(changes.withColumns(builds_on)), 1_000_000_000_000)


@query(
    "registry_cas_refused",
    "ring",
    """SELECT id AS seq, 'update' AS op, id AS id, 'condition_failed' AS reason FROM ring WHERE id % 6 = 0
        UNION ALL SELECT id + 2000000000, CASE id % 3 WHEN 0 THEN 'update' ELSE 'create' END, CASE WHEN id % 3 = 2 THEN id + 1000000000 ELSE id END, 'condition_failed' FROM ring WHERE id % 3 <> 1
        UNION ALL SELECT id + 4000000000, 'update', id, 'condition_failed' FROM ring WHERE id % 6 = 0 OR id % 3 = 1""",
)
def registry_cas_refused(spark, sf):
    return cas(spark, sf)[1].select("seq", "op", "id", "reason")


@query(
    "seeds",
    "ring",
    """SELECT app, dc, id, seed_rack, seed FROM (SELECT n.app, n.dc, n.id, s.rack AS seed_rack, s.hostname AS seed,
        row_number() OVER (PARTITION BY n.app, n.dc, n.id, s.rack ORDER BY s.id) AS rn
        FROM ring n JOIN ring s ON n.app = s.app AND s.instance_id <> 'new_slot' AND s.hostname <> n.hostname) WHERE rn = 1""",
)
def seeds(spark, sf):
    sizes = T.ring(spark, sf).groupBy("app", "rack").agg(F.count(F.lit(1)).alias("max_size"))
    return R.seeds(T.ring(spark, sf), sizes)


@query(
    "is_seed",
    "ring",
    "SELECT app, dc, id, hostname = first_value(hostname) OVER (PARTITION BY app, rack ORDER BY id, dc) AS is_seed FROM ring",
)
def is_seed(spark, sf):
    return R.is_seed(T.ring(spark, sf))


# --- gossip ---------------------------------------------------------------------------------


@query(
    "observer_view",
    "obs",
    "SELECT app, token, seq, CASE WHEN reachable THEN ip END AS ip, CASE WHEN reachable THEN live END AS live, reachable FROM obs",
)
def observer_view(spark, sf):
    return gossip.observer_view(T.observations(spark, sf)).select("app", "token", "seq", "ip", "live", "reachable")


@T.shared_plan
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    asked = gossip.eligible_observations(T.observations(spark, sf), T.asked_tokens(spark, sf))
    return gossip.gossip_consensus(gossip.observer_view(asked))


def asked_by(key):
    """Application, dc and token a customer stands for; some no observer knows."""
    return F.concat(F.lit("app"), T.text(key % 3)).alias("app"), F.concat(F.lit("dc"), T.text(key % 2)).alias("dc"), T.text(key % 300).alias("token")


@query("gossip_consensus", "consensus", "SELECT * FROM consensus")
def gossip_consensus(spark, sf):
    return consensus(spark, sf)


@query(
    "replace_ip_decision",
    "consensus",
    """SELECT app, dc, token, coalesce(status, 'UNREACHABLE_NODES') AS status, CASE WHEN status IS NULL OR status = 'UNREACHABLE_NODES' THEN registry_ip
        WHEN status = 'GOOD' AND NOT live THEN ip END AS replace_ip
        FROM (SELECT 'app' || (c_custkey % 3) AS app, 'dc' || (c_custkey % 2) AS dc, (c_custkey % 300)::VARCHAR AS token, 'ip-' || c_custkey AS registry_ip FROM customer) LEFT JOIN consensus USING (app, dc, token)""",
)
def replace_ip_decision(spark, sf):
    key = F.col("c_custkey")
    tokens = T.table(spark, sf, "customer").select(
        *asked_by(key), F.concat(F.lit("ip-"), T.text(key)).alias("registry_ip")
    )
    return gossip.replace_ip_existing(tokens, consensus(spark, sf))


@query(
    "replace_ip_assigned",
    "consensus",
    """SELECT app, dc, token, coalesce(status, 'UNREACHABLE_NODES') AS status, CASE WHEN status = 'GOOD' AND ip <> host AND NOT live THEN ip END AS replace_ip,
        CASE WHEN status = 'GOOD' AND ip <> host AND live THEN 'owner_alive' WHEN status = 'MISMATCH' THEN 'gossip_mismatch' END AS error
        FROM (SELECT 'app' || (c_custkey % 3) AS app, 'dc' || (c_custkey % 2) AS dc, (c_custkey % 300)::VARCHAR AS token, '10.0.0.' || (c_custkey % 5) AS host FROM customer) LEFT JOIN consensus USING (app, dc, token)""",
)
def replace_ip_assigned(spark, sf):
    key = F.col("c_custkey")
    host = F.concat(F.lit("10.0.0."), T.text(key % 5))
    tokens = T.table(spark, sf, "customer").select(
        *asked_by(key), host.alias("host_ip"), host.alias("private_ip")
    )
    return gossip.replace_ip_assigned(tokens, consensus(spark, sf))


@T.shared_plan
def gossip_dumps(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    block = F.concat(
        F.lit("/ip-"), T.text(key), F.lit("\n  generation:1\n  heartbeat:"), T.text(key * 3),
        F.lit("\n  STATUS:16:NORMAL,-"), T.text(key), F.lit("\n  DC:8:"), F.lower("s_name"), F.lit("\n  TOKENS:15:<hidden>\n"),
        F.lit("/short\n  a:b\n"),
    )
    return T.table(spark, sf, "supplier").select(T.text(key).alias("dump_id"), block.alias("dump"))


@query(
    "parse_gossip_dump",
    "ring",
    """SELECT public_ip, unnest(['PUBLIC_IP', 'GENERATION', 'HEARTBEAT', 'STATUS', 'DC', 'TOKENS']) AS name,
        unnest([public_ip, '1', (s_suppkey * 3)::VARCHAR, 'NORMAL', lower(s_name), token]) AS value
        FROM (SELECT 'ip-' || s_suppkey AS public_ip, s_suppkey, s_name, tok::VARCHAR AS token
            FROM supplier JOIN ring ON id = s_suppkey)""",
)
def parse_gossip_dump(spark, sf):
    """Dumps of up to 500 nodes each, written as text files and read from them."""
    path = shared_dir(spark, "gossip-dumps")
    gossip_dumps(spark, sf).select("dump").write.option("maxRecordsPerFile", 500).text(path)
    tokens = T.ring(spark, sf).select(F.col("ip").alias("public_ip"), F.col("token").alias("tokens"))
    nodes = gossip_dump.parse_gossip_dump(gossip_dump.read_dumps(spark, path), tokens)
    return nodes.select("public_ip", F.explode("attributes").alias("name", "value"))


@query(
    "ring_status",
    "ring",
    """SELECT app, ip AS endpoint, CASE WHEN id % 9 = 0 THEN 'Unknown' ELSE dc END AS dc, CASE WHEN id % 9 = 0 THEN 'Unknown' ELSE rack END AS rack,
        CASE id % 4 WHEN 0 THEN 'Down' WHEN 3 THEN '?' ELSE 'Up' END AS status, CASE id % 5 WHEN 0 THEN 'Joining' WHEN 1 THEN 'Leaving' WHEN 2 THEN 'Moving' ELSE 'Normal' END AS state,
        CASE WHEN id % 8 = 0 THEN '?' ELSE id || ' KB' END AS load, CASE WHEN id % 6 = 0 THEN '0.00%' ELSE (id % 100) || '.00%' END AS owns, tok::VARCHAR AS token FROM ring""",
)
def ring_status(spark, sf):
    ring, key = T.ring(spark, sf), F.col("id")
    ends = ring.withColumn("endpoint", F.col("ip"))
    health_list = F.when(key % 4 == 0, "unreachable").when(key % 4 != 3, "live")
    move_list = F.when(key % 5 == 0, "joining").when(key % 5 == 1, "leaving").when(key % 5 == 2, "moving")
    states = ends.select("app", "endpoint", F.explode(F.array(health_list, move_list)).alias("state"))
    loads = ends.filter(key % 8 != 0).select("app", "endpoint", F.concat(T.text(key), F.lit(" KB")).alias("load"))
    places = ends.filter(key % 9 != 0).select("app", "endpoint", "dc", "rack")
    owned = ends.filter(key % 6 != 0).select("app", "endpoint", ((key % 100) / 100).alias("owned"))
    return gossip.ring_status(ends.select("app", "token", "endpoint"), states, loads, places, owned)


# --- tables, compactions, histograms --------------------------------------------------------


@T.shared_plan
def schema_tables(spark: SparkSession, sf: str) -> DataFrame:
    system = T.table(spark, sf, "customer").select(
        F.lit("app0").alias("app"), F.lit("system_auth").alias("keyspace"), F.concat(F.lit("t"), T.text(F.col("c_custkey"))).alias("column_family")
    )
    own = T.objects(spark, sf).select(F.col("cluster").alias("app"), "keyspace", "column_family")
    return own.unionByName(system)


TABLES = "(SELECT DISTINCT cluster AS app, keyspace, column_family FROM obj0)"


@query(
    "tables_by_keyspace",
    "obj0",
    f"SELECT app, keyspace, column_family FROM {TABLES} UNION ALL SELECT 'app0', 'system_auth', 't' || c_custkey FROM customer",
)
def tables_by_keyspace(spark, sf):
    return admin.tables_by_keyspace(schema_tables(spark, sf))


@query(
    "compaction_targets",
    "obj0",
    f"""SELECT app, keyspace, column_family FROM {TABLES} WHERE (keyspace IN ('ks1', 'ks4') OR (keyspace = 'ks2' AND column_family IN ('cf1', 'cf2', 'cf3')))
        AND keyspace <> 'ks4' AND NOT (keyspace = 'ks1' AND column_family IN ('cf5', 'cf6'))""",
)
def compaction_targets(spark, sf):
    return admin.compaction_targets(schema_tables(spark, sf), "ks1.*,ks4.*,ks2.cf1,ks2.cf2,ks2.cf3", "ks4.*,ks1.cf5,ks1.cf6")


@query(
    "flush_targets",
    "obj0",
    f"""SELECT app, keyspace, NULL::VARCHAR AS error FROM {TABLES} GROUP BY 1, 2
        UNION ALL SELECT 'app1', 'c' || c_nationkey, 'no_such_keyspace' FROM customer GROUP BY 1, 2""",
)
def flush_targets(spark, sf):
    known = schema_tables(spark, sf).select("app", "keyspace")
    unknown = T.table(spark, sf, "customer").select(
        F.lit("app1").alias("app"), F.concat(F.lit("c"), T.text(F.col("c_nationkey"))).alias("keyspace")
    )
    return admin.flush_targets(schema_tables(spark, sf), known.unionByName(unknown))


@query(
    "compaction_progress",
    "",
    """SELECT l_orderkey AS id, l_linenumber::BIGINT AS part, total_bytes, CASE WHEN total_bytes = 0 THEN 'n/a' ELSE (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') || '%' END AS progress
        FROM (SELECT *, CASE WHEN total_bytes = 0 THEN NULL ELSE q + CASE WHEN 2 * r > total_bytes OR (2 * r = total_bytes AND q % 2 = 1) THEN 1 ELSE 0 END END AS h FROM (
            SELECT *, CASE WHEN total_bytes > 0 THEN done * 10000 // total_bytes END AS q, CASE WHEN total_bytes > 0 THEN done * 10000 % total_bytes END AS r FROM (
                SELECT l_orderkey, l_linenumber, l_partkey % 97 AS total_bytes, l_quantity::BIGINT AS done FROM lineitem)))""",
)
def compaction_progress(spark, sf):
    running = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").cast("bigint").alias("part"),
        (F.col("l_partkey") % 97).alias("total_bytes"),
        F.col("l_quantity").cast("bigint").alias("bytes_complete"),
    )
    return admin.compaction_progress(running).drop("bytes_complete")


@query(
    "cf_histogram_table",
    "obj0",
    """SELECT keyspace, column_family, b::BIGINT AS bucket, o::BIGINT AS "offset", s AS sstables, w AS write_latency, r AS read_latency, z AS row_size, c AS column_count FROM (
        SELECT keyspace, column_family, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS b, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS o,
        unnest([n1, n2, n3, NULL, NULL, NULL, NULL, NULL]) AS s, unnest([n1, n2, n3, n4, NULL, NULL, NULL, NULL]) AS w,
        unnest([n4, n3, n2, n1, n1, NULL, NULL, NULL]) AS r, unnest([n1, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS z,
        unnest([n1, n2, n3, n4, n4, n3, n2, n1]) AS c FROM (SELECT keyspace, column_family, count(*) FILTER (size < 10000) AS n1, count(*) FILTER (size < 20000) AS n2,
            count(*) FILTER (size < 30000) AS n3, count(*) FILTER (size < 40000) AS n4 FROM obj0 GROUP BY 1, 2))""",
)
def cf_histogram_table(spark, sf):
    counts = T.objects(spark, sf).groupBy("keyspace", "column_family").agg(
        *[F.count_if(F.col("size") < i * 10_000).alias(f"n{i}") for i in range(1, 5)]
    )
    histograms = counts.withColumns(
        {
            "offsets": F.array(*[F.lit(o) for o in admin.histogram_offsets(8)]),
            "sstables": F.array("n1", "n2", "n3"),
            "write_latency": F.array("n1", "n2", "n3", "n4"),
            "read_latency": F.array("n4", "n3", "n2", "n1", "n1"),
            "row_size": F.array("n1"),
            "column_count": F.array("n1", "n2", "n3", "n4", "n4", "n3", "n2", "n1"),
        }
    )
    table = admin.cf_histogram_table(histograms, ["keyspace", "column_family"])
    return table.withColumns({"bucket": F.col("bucket").cast("bigint"), "offset": F.col("offset").cast("bigint")})


# --- settings, health, metrics, messages ----------------------------------------------------


@query(
    "scan_properties",
    "cfg",
    "SELECT node, property, value, seq FROM cfg WHERE length(value) > 0",
)
def scan_properties(spark, sf):
    return sources.scan_properties(T.config_rows(spark, sf)).select("node", "property", "value", "seq")


@query(
    "scan_config_region",
    "cfg",
    """SELECT app, property, CASE WHEN count(*) FILTER (region = 'region-1') > 0 THEN (arg_max({'v': value}, seq) FILTER (region = 'region-1')).v
        ELSE (arg_min({'v': value}, seq) FILTER (region = '')).v END AS value FROM cfg WHERE region IN ('', 'region-1') GROUP BY 1, 2""",
)
def scan_config_region(spark, sf):
    return sources.scan_config_region(T.config_rows(spark, sf), "region-1")


@query(
    "effective_config",
    "cfg",
    """SELECT app, node, property, value, priority::BIGINT AS source FROM (SELECT *, row_number() OVER (PARTITION BY app, node, property ORDER BY priority, value) AS rn
        FROM cfg WHERE value IS NOT NULL) WHERE rn = 1""",
)
def effective_config(spark, sf):
    values = V.effective_config(T.config_rows(spark, sf))
    return values.withColumn("source", F.col("source").cast("bigint"))


@query(
    "typed_config",
    "cfg",
    """SELECT app, node, property, CASE property WHEN '1' THEN 'false' WHEN '2' THEN CASE WHEN length(value) > 3 THEN '7' ELSE value END ELSE value END AS typed
        FROM (SELECT app, node, property, CASE WHEN property = '2' AND length(value) > 3 THEN 'x' || value ELSE value END AS value,
        row_number() OVER (PARTITION BY app, node, property ORDER BY priority, value) AS rn FROM cfg WHERE value IS NOT NULL) WHERE rn = 1""",
)
def typed_config(spark, sf):
    values = V.effective_config(T.config_rows(spark, sf))
    broken = (F.col("property") == "2") & (F.length("value") > 3)
    values = values.withColumn("value", F.when(broken, F.concat(F.lit("x"), "value")).otherwise(F.col("value")))
    typed = V.typed_config(values, {"1": ("boolean", True), "2": ("int", 7)})
    return typed.select("app", "node", "property", "typed")


_FLAG = "coalesce(arg_max(value, {{'t': ts_ms, 's': seq}}) FILTER (flag = '{name}'), {default})"


def _sql_flags() -> str:
    return ", ".join(
        f"{_FLAG.format(name=name, default=str(name == 'healthy_override').upper())} AS {name}" for name in health.FLAGS
    )


HEALTH = f"""SELECT *, restoring OR (alive AND directories AND gossip AND yml_written AND healthy_override AND (thrift OR native)) AS healthy
    FROM (SELECT node, {_sql_flags()} FROM fl GROUP BY 1)"""


@query("health_status", "fl", HEALTH)
def health_status(spark, sf):
    return health.health_status(T.health_flags(T.table(spark, sf, "events")))


METRICS = """SELECT node, kind, count(*) AS events, sum(size)::BIGINT AS total_size, max(size) AS max_size,
    sum(size)::BIGINT // count(*) AS mean_size FROM tr GROUP BY 1, 2"""


@query("transfer_metrics", "tr", METRICS)
def transfer_metrics(spark, sf):
    return transfer.transfer_metrics(T.transfers(T.table(spark, sf, "events")))


MESSAGE = """'{"s3bucketname":"store","s3clustername":"' || cluster || '","s3namespace":"' || remote_path || '"' ||
    coalesce(',"keyspace":"' || keyspace || '","cf":"' || column_family || '"', '') || ',"rack":"r1","token":"' || token || '","filename":"' || file_name ||
    '","uncompressfilesize":' || size || ',"compressfilesize":' || (size // 2) || ',"backuptype":"' || file_type ||
    '","uploadstatus":"success","compression":"SNAPPY","encryption":"PLAINTEXT","isincremental":false}'"""


@T.shared_plan
def uploaded(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_v2(spark, sf).withColumns(
        {
            "bucket": F.lit("store"),
            "rack": F.lit("r1"),
            "compressed_size": F.expr("size div 2"),
            "upload_status": F.lit("SUCCESS"),
            "is_incremental": F.lit(False),
        }
    )


@query(
    "notifications",
    "v2",
    f"""SELECT remote_path, {MESSAGE} AS message, '{{"s3clustername":"' || cluster || '","backuptype":"' || file_type || '","token":"' || token || '"}}' AS attributes
        FROM v2 WHERE file_type = 'SST_V2'""",
)
def notifications(spark, sf):
    messages = notify.upload_notifications(uploaded(spark, sf), "SST_V2, nonsense", ["token", "absent"])
    return messages.withColumn("attributes", F.to_json("attributes"))


@query(
    "notify_sink",
    "v2",
    f"SELECT 'backups' AS topic, remote_path AS key, {MESSAGE} AS value, 2::BIGINT AS n_headers FROM v2",
)
def notify_sink(spark, sf):
    """Messages written to the sink as one batch and read back from it."""
    path = shared_dir(spark, "notify-sink")
    notify.notify_sink(notify.upload_notifications(uploaded(spark, sf), ""), path, 0)
    rows = notify.as_topic_rows(notify.read_sink(spark, path), "backups")
    return rows.select("topic", "key", "value", F.size("headers").cast("bigint").alias("n_headers"))


@query(
    "verified_notifications",
    "run verdict",
    f"""SELECT location AS remote_path, '{{"s3bucketname":"store","s3clustername":"' || cluster || '","s3namespace":"' || location ||
        '","region":"us-east-1","rack":"r1","token":"' || token || '","backuptype":"SNAPSHOT_VERIFIED","snapshotInstant":' || start_ms || '}}' AS message
        FROM {CHECKED} WHERE valid AND last_validated_ms IS NULL""",
)
def verified_notifications(spark, sf):
    verified = verify.verify_backups_in_range(run_records(spark, sf), run_verdicts(spark, sf, SPAN, force=False), 2, SPAN)
    runs = verified.filter("newly_validated").select(
        F.lit("store").alias("bucket"),
        "cluster",
        F.col("location").alias("remote_path"),
        F.lit("us-east-1").alias("region"),
        F.lit("r1").alias("rack"),
        "token",
        F.col("start_ms").alias("snapshot_instant"),
    )
    return notify.verified_notifications(runs).select("remote_path", "message")


def paced_transfers(events: DataFrame) -> DataFrame:
    """Transfers with the deadline, bytes and threads the pacing looks at."""
    rows = T.transfers(events)
    return rows.select(
        "node",
        "ts_ms",
        "seq",
        F.when(F.col("kind") == "error", F.lit(0)).otherwise(F.lit(1_706_745_600_000)).cast("bigint").alias("target_ms"),
        (F.col("kind") != "signup").alias("in_snapshot"),
        (F.col("size") * 1000).alias("total_bytes"),
        F.lit(2).alias("threads"),
    )


@query(
    "wanted_rates",
    "tr",
    """SELECT node, ts_ms, seq, CASE WHEN kind <> 'error' AND kind <> 'signup' AND 1706745600000 - ts_ms >= 1000 AND size * 1000 // 2 >= 1
        THEN (size * 1000 // 2)::DOUBLE / ((1706745600000 - ts_ms) // 1000)::DOUBLE END AS wanted_rate FROM tr""",
)
def wanted_rates(spark, sf):
    return pacing.wanted_rates(paced_transfers(T.table(spark, sf, "events")))
