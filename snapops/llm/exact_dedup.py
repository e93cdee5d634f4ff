"""Exact deduplication as a stateful stream, with a check of the full bytes on every hit.

A streaming aggregation keeps, for each digest of a normalised text, the smallest document
id, the file that document lies in and the number of rows seen. The state lives in RocksDB
on the executors' disks and never expires, so a copy is found however late it comes. Each
micro-batch writes the digests it changed to the shared folder; the last state of each
digest decides. Documents that hit a digest are then compared with the kept document byte
by byte, and digests that differ are grouped anew by the text itself.

Defined cases: null text is the empty text; rows with a null id come after all others when
the smallest id is chosen, and a group of them alone keeps a null id; repeated rows count as
often as they occur and share one fate; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapops.llm.common import saved
from snapops.session import shared_dir

#: State on disk; its files are not allocated ahead, as a store for each partition may be small.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return becomes one space."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def _first(doc_id: Column, locator: Column) -> Column:
    return F.min(F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), locator.alias("locator")))


def retain(stream: DataFrame, into: str, checkpoint: str, **trigger) -> None:
    """Run a stream of ``doc_id, digest, locator`` to its end; write changed states below ``into``.

    A batch that is run again after a failure overwrites its own folder. ``trigger`` is that
    of the stream; by default all that is there is read, then it stops. A later call with the
    same ``checkpoint`` goes on with the state.
    """
    spark = stream.sparkSession
    state = stream.groupBy("digest").agg(_first(F.col("doc_id"), F.col("locator")).alias("first"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def states(spark: SparkSession, into: str) -> DataFrame:
    """The last state of each digest: ``digest, keep_id, locator, group_size``."""
    schema = "digest string, first struct<no_id: boolean, doc_id: bigint, locator: string>, n bigint"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{into}/batch=-1")
    last = spark.read.schema(schema).parquet(into).groupBy("digest").agg(F.max_by("first", "n").alias("first"), F.max("n").alias("group_size"))
    return last.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size")


def _pattern(path: str) -> str:
    """A glob that matches the path alone: a stream reads a single file only by a glob."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def exact_duplicates(spark: SparkSession, path: str, batch_bytes: int = 64 << 30) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, locator`` for each row of the files at ``path``.

    ``batch_bytes`` bounds one micro-batch, not the result.
    """
    docs = spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    digested = docs.withColumn("digest", F.sha2("text", 256))
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(_pattern(path))
    stream = raw.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("digest"), F.col("_metadata.file_path").alias("locator"))
    into = shared_dir(spark, "exact-states")
    retain(stream, into, shared_dir(spark, "exact-stream"))
    known = saved(states(spark, into), "exact-known")

    hits = saved(digested.join(known.where("group_size > 1").select("digest", "keep_id"), "digest"), "exact-hits")
    keepers = hits.where("doc_id <=> keep_id").groupBy("digest").agg(F.first("text").alias("kept_text"))
    clashing = hits.join(keepers, "digest").where("text <> kept_text").select("digest").distinct()
    by_text = hits.join(clashing, "digest", "left_semi").groupBy("digest", "text").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
    regrouped = hits.join(by_text, ["digest", "text"]).select("doc_id", "digest", "own_id", "own_size", F.lit(True).alias("differs")).distinct()

    rows = digested.select("doc_id", "digest").join(known, "digest")
    rows = rows.alias("r").join(regrouped.alias("g"), F.expr("r.digest = g.digest AND r.doc_id <=> g.doc_id"), "left")
    keep, size = (F.when(F.col("g.differs"), F.col(own)).otherwise(F.col(all_)) for own, all_ in (("g.own_id", "r.keep_id"), ("g.own_size", "r.group_size")))
    return rows.select("r.doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("r.doc_id").eqNullSafe(keep).alias("kept"), F.col("r.digest").alias("text_sha256"), "r.locator")
