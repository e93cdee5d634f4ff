import pytest
from pyspark.sql import functions as F

from snapops.operators import health, notify
from snapops.operators import status as S
from snapops.streaming import streams


def arrive(df, folder, pieces):
    """Split a frame over files that a stream picks up one per micro-batch."""
    df.repartitionByRange(pieces, "seq").write.parquet(str(folder))


def test_streamed_aggregates_equal_the_batch(spark, tmp_path):
    flags = spark.range(400).select(
        (F.col("id") % 5).cast("string").alias("node"),
        F.element_at(F.array(*[F.lit(f) for f in health.FLAGS]), (F.col("id") % 8 + 1).cast("int")).alias("flag"),
        (F.hash("id") % 3 != 0).alias("value"),
        F.col("id").alias("ts_ms"),
        F.col("id").alias("seq"),
    )
    arrive(flags, tmp_path / "flags", 4)
    stream = streams.read_stream(spark, str(tmp_path / "flags"), flags.schema, files_per_batch=1)
    streams.stream_health(stream, str(tmp_path / "health"))
    found = streams.read_latest(spark, str(tmp_path / "health"), ["node"])
    expected = health.health_status(flags)
    assert sorted(found.select(*expected.columns).collect()) == sorted(expected.collect())


def run_events(spark, n=300, days=6):
    kinds = F.array(F.lit("STARTED"), F.lit("FINISHED"), F.lit("FAILED"))
    return spark.range(n).select(
        F.lit("c").alias("cluster"), F.lit("1").alias("token"), F.lit(2).alias("version"), (F.hash("id") % 40 * 1000 + 40_000 + F.col("id") % days * 86_400_000).alias("start_ms"),
        F.col("id").alias("event_ms"), F.col("id").alias("seq"), F.element_at(kinds, (F.hash("id") % 3 + 3).cast("int") % 3 + 1).alias("status"),
        F.when(F.col("id") % 11 == 0, F.col("id") * 10).alias("completed_ms"), F.lit(True).alias("snapshot_ok"), F.concat(F.lit("m"), "id").alias("location"),
        F.lit(None).cast("bigint").alias("last_validated_ms"),
    )


def test_streamed_runs_equal_the_batch_and_are_stored_once(spark, tmp_path):
    events = run_events(spark)
    expected = S.status_fold(events)
    arrive(events, tmp_path / "events", 4)
    streams.stream_status(streams.read_stream(spark, str(tmp_path / "events"), events.schema, files_per_batch=1), str(tmp_path / "runs"))
    found = streams.read_runs(spark, str(tmp_path / "runs")).select(*expected.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    day = found.first().snapshot_date
    assert streams.read_runs(spark, str(tmp_path / "runs"), day).count() == expected.filter(F.col("snapshot_date") == day).count()
    held = streams.part_batches(spark, str(tmp_path / "runs"))
    assert streams._read_parts(spark, str(tmp_path / "runs"), held).count() == expected.count()


def test_a_batch_of_runs_touches_its_days_only(spark, tmp_path):
    first, second = run_events(spark, 200, 6), run_events(spark, 40, 1).withColumn("seq", F.col("seq") + 1000)
    path = str(tmp_path / "runs")
    arrive(first, tmp_path / "events", 1)
    stream = lambda: streams.read_stream(spark, str(tmp_path / "events"), first.schema, files_per_batch=1)
    streams.stream_status(stream(), path)
    second.write.mode("append").parquet(str(tmp_path / "events"))
    streams.stream_status(stream(), path)
    held = streams.part_batches(spark, path)
    assert len(held) == 6 and sum(b == 0 for b in held.values()) == 5
    expected = S.status_fold(first.unionByName(second))
    found = streams.read_runs(spark, path).select(*expected.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_metrics_count_every_event_in_any_file_order(spark, tmp_path):
    events = spark.range(1000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.lit(999) - F.col("id")) * 120).alias("ts"), (F.col("id") % 3).cast("string").alias("node"),
        F.lit("put").alias("kind"), (F.col("id") * 7 % 100).alias("size"), F.col("id").alias("seq"),
    )
    for pieces in (1, 4):
        arrive(events, tmp_path / f"in{pieces}", pieces)
        streams.stream_metrics(streams.read_stream(spark, str(tmp_path / f"in{pieces}"), events.schema, files_per_batch=1), str(tmp_path / f"out{pieces}"))
        found = streams.read_metrics(spark, str(tmp_path / f"out{pieces}"))
        assert found.agg(F.sum("events")).first()[0] == 1000
        expected = streams.windowed_metrics(events)
        assert sorted(found.select(*expected.columns).collect()) == sorted(expected.collect())


def test_incrementals_once_and_only_new(spark, tmp_path):
    rows = [(i % 6, f"ks{i % 2}", 0 if i % 6 == 5 else 9, i) for i in range(18)]
    files = spark.createDataFrame(rows, "n int, keyspace string, size bigint, seq bigint").select(
        F.lit("c").alias("cluster"), F.lit("1").alias("token"), "keyspace", F.lit("cf").alias("column_family"), F.lit("SST_V2").alias("file_type"),
        F.concat(F.lit("r/"), "n").alias("remote_path"), F.concat(F.lit("l/"), "n").alias("local_path"), "size", F.timestamp_seconds(F.lit(10**7) - F.col("seq") * 10**6 % (10**7 - 1)).alias("arrived"), "seq",
    )
    arrive(files, tmp_path / "in", 3)
    known = spark.createDataFrame([("r/2",)], "remote_path string")
    stream = streams.read_stream(spark, str(tmp_path / "in"), files.schema, files_per_batch=1)
    streams.stream_incrementals(stream, known, str(tmp_path / "out"))
    assert sorted(r.remote_path for r in streams.read_appended(spark, str(tmp_path / "out")).collect()) == ["r/0", "r/1", "r/3", "r/4"]


def test_incrementals_do_not_depend_on_the_number_of_batches(spark, tmp_path):
    files = spark.range(400).select(
        F.lit("c").alias("cluster"), F.lit("1").alias("token"), F.lit("ks").alias("keyspace"), F.lit("cf").alias("column_family"),
        F.when(F.col("id") % 10 == 0, "META_V2").otherwise("SST_V2").alias("file_type"), F.concat(F.lit("r/"), F.col("id") % 90).alias("remote_path"),
        F.concat(F.lit("l/"), F.col("id") % 90).alias("local_path"), F.lit(9).cast("bigint").alias("size"), F.timestamp_seconds(F.col("id")).alias("arrived"), F.col("id").alias("seq"),
    )
    known = spark.createDataFrame([(f"r/{i}",) for i in range(0, 90, 3)], "remote_path string")
    expected = {f"r/{i}" for i in range(90) if i % 3 or i % 10 == 0}
    for pieces in (1, 20):
        arrive(files, tmp_path / f"in{pieces}", pieces)
        out = str(tmp_path / f"out{pieces}")
        query = streams.stream_incrementals(streams.read_stream(spark, str(tmp_path / f"in{pieces}"), files.schema, files_per_batch=1), known, out)
        found = [r.remote_path for r in streams.read_appended(spark, out).collect()]
        assert sorted(found) == sorted(expected)
        state = query.lastProgress.stateOperators[0]
        assert state.numRowsTotal <= 90 + 90
        if pieces == 20:
            assert query.lastProgress.numInputRows <= 2 * 400 / 20, "a batch reads its own file only"
    # a later start goes on with the state
    files.limit(5).write.mode("append").parquet(str(tmp_path / "in20"))
    streams.stream_incrementals(streams.read_stream(spark, str(tmp_path / "in20"), files.schema), known, str(tmp_path / "out20"))
    assert streams.read_appended(spark, str(tmp_path / "out20")).count() == len(expected)


def test_each_message_is_in_the_sink_once(spark, tmp_path, monkeypatch):
    uploads = spark.range(60).select(
        F.concat(F.lit("k"), "id").alias("remote_path"), F.lit("SST_V2").alias("file_type"), F.lit("success").alias("upload_status"), F.lit("c").alias("cluster"), F.col("id").alias("seq"),
        *[F.lit(None).cast("string").alias(c) for c in ("bucket", "keyspace", "column_family", "region", "rack", "token", "file_name", "size", "compressed_size", "compression", "encryption", "is_incremental")],
    )
    arrive(uploads, tmp_path / "in", 3)
    stream = lambda: streams.read_stream(spark, str(tmp_path / "in"), uploads.schema, files_per_batch=1)
    path, committed = str(tmp_path / "out"), notify.commit

    def dies(session, where, batch):
        if batch == 1:
            raise RuntimeError("between write and commit")
        committed(session, where, batch)

    monkeypatch.setattr(notify, "commit", dies)
    with pytest.raises(Exception, match="between write and commit"):
        streams.stream_notifications(stream(), path)
    assert notify.read_sink(spark, path).count() == 20
    monkeypatch.setattr(notify, "commit", committed)
    streams.stream_notifications(stream(), path)
    found = [r.remote_path for r in notify.read_sink(spark, path).collect()]
    assert sorted(found) == sorted(f"k{i}" for i in range(60))


def test_sources_without_files_read_as_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    events = "ts timestamp, node string, kind string, size bigint, seq bigint"
    streams.stream_metrics(streams.read_stream(spark, str(tmp_path / "none"), events), str(tmp_path / "metrics"))
    assert streams.read_metrics(spark, str(tmp_path / "metrics")).count() == 0
    flags = "node string, flag string, value boolean, ts_ms long, seq long"
    streams.stream_health(streams.read_stream(spark, str(tmp_path / "none"), flags), str(tmp_path / "health"))
    assert streams.read_latest(spark, str(tmp_path / "health"), ["node"]).count() == 0
    runs = run_events(spark, 1).schema
    streams.stream_status(streams.read_stream(spark, str(tmp_path / "none"), runs), str(tmp_path / "runs"))
    assert streams.read_runs(spark, str(tmp_path / "runs")).count() == 0
