"""The streaming jobs run to the end over the given files, and their results read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.operators import notify
from snapops.operators.health import FLAGS
from snapops.plans import tables as T
from snapops.plans.node_queries import HEALTH
from snapops.plans.registry import query
from snapops.session import shared_dir, use_utc
from snapops.streaming import streams


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return streams.read_stream(use_utc(spark), sf, T.SCHEMAS[name], f"{name}.parquet")


@query(
    "stream_metrics",
    "tr",
    """SELECT ts_ms // 600000 * 600000 AS window_ms, node, kind, count(*) AS events, sum(size)::BIGINT AS total_size, max(size) AS max_size
        FROM tr GROUP BY 1, 2, 3""",
)
def stream_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    streams.stream_metrics(T.transfers(source(spark, sf, "events")), path)
    return streams.read_metrics(spark, path)


@query("stream_health", "fl", HEALTH)
def stream_health(spark, sf):
    path = shared_dir(spark, "health")
    streams.stream_health(T.health_flags(source(spark, sf, "events")), path)
    return streams.read_latest(spark, path, ["node"]).select("node", *FLAGS, "healthy")


@query("stream_status", "run", "SELECT * FROM run")
def stream_status(spark, sf):
    path = shared_dir(spark, "runs")
    streams.stream_status(T.status_rows(source(spark, sf, "orders")), path, "yyyyMM")
    return streams.read_runs(spark, path)


def incremental_files(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    """Line items as incremental files of the node that holds their order."""
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_shipdate").cast("timestamp").alias("arrived"),
        F.concat(F.lit("app"), T.text(F.col("o_custkey") % 2)).alias("cluster"),
        T.text(F.col("o_custkey") % 10).alias("token"),
        F.concat(F.lit("ks"), T.text(F.col("l_partkey") % 7)).alias("keyspace"),
        F.concat(F.lit("cf"), T.text(F.col("l_partkey") % 11)).alias("column_family"),
        F.lit("SST_V2").alias("file_type"),
        (F.col("l_quantity").cast("bigint") - 1).alias("size"),
        F.concat(F.lit("mc-"), T.text(F.col("l_partkey")), F.lit("-Data.db")).alias("file_name"),
    ).withColumns({"remote_path": incremental_path(), "local_path": incremental_path()})


def incremental_path():
    return F.concat_ws("/", "cluster", "token", "keyspace", "column_family", "file_name")


@query(
    "stream_incrementals",
    "",
    """SELECT DISTINCT 'app' || (o_custkey % 2) AS cluster, (o_custkey % 10)::VARCHAR AS token,
        'app' || (o_custkey % 2) || '/' || (o_custkey % 10) || '/ks' || (l_partkey % 7) || '/cf' || (l_partkey % 11) || '/mc-' || l_partkey || '-Data.db' AS remote_path
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 1 AND l_partkey % 7 <> 4
        AND (o_custkey % 2, o_custkey % 10, l_partkey) NOT IN (SELECT o_custkey % 2, o_custkey % 10, l_partkey
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 10)""",
)
def stream_incrementals(spark, sf):
    path = shared_dir(spark, "incrementals")
    known = incremental_files(spark, sf, T.table(spark, sf, "lineitem").filter(F.col("l_quantity") < 10))
    arriving = incremental_files(spark, sf, source(spark, sf, "lineitem"))
    streams.stream_incrementals(arriving, known, path, exclude="ks4.*")
    return streams.read_appended(spark, path).select("cluster", "token", "remote_path")


@query(
    "stream_notifications",
    "",
    """SELECT 'k' || event_id AS remote_path, '{"s3bucketname":"store","s3clustername":"app","s3namespace":"k' || event_id || '","token":"' || user_id ||
        '","uncompressfilesize":' || round(value * 1000)::BIGINT || ',"backuptype":"' || CASE event_type WHEN 'purchase' THEN 'META_V2' ELSE 'SST_V2' END ||
        '","uploadstatus":"' || CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END || '","isincremental":true}' AS message
        FROM events WHERE event_type <> 'purchase'""",
)
def stream_notifications(spark, sf):
    path = shared_dir(spark, "messages")
    events = source(spark, sf, "events")
    none = F.lit(None).cast("string")
    unknown = ["keyspace", "column_family", "region", "rack", "file_name", "compression", "encryption"]
    uploads = events.select(
        F.concat(F.lit("k"), T.text(F.col("event_id"))).alias("remote_path"),
        F.lit("store").alias("bucket"),
        F.lit("app").alias("cluster"),
        T.text(F.col("user_id")).alias("token"),
        F.round(F.col("value") * 1000).cast("bigint").alias("size"),
        F.lit(None).cast("bigint").alias("compressed_size"),
        F.when(F.col("event_type") == "purchase", "META_V2").otherwise("SST_V2").alias("file_type"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("upload_status"),
        F.lit(True).alias("is_incremental"),
        *[none.alias(name) for name in unknown],
    )
    streams.stream_notifications(uploads, path, "SST_V2")
    return notify.read_sink(spark, path).select("remote_path", "message")
