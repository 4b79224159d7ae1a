import time

import pytest
from pyspark.sql import Window as W, functions as F

from eventloom.operators import cleaning, sessions
from eventloom.sources.tables import load_events, with_copies
from eventloom.streaming import finite, numbering
from eventloom.streaming.bursts import remove_bursts_stream
from eventloom.streaming.sessions import session_summary_stream, timeless_events_stream
from tests.support import TESTDATA, event

SF_DIR = f"{TESTDATA}/sf0.001"


def as_stream(spark, df, folder, batches=4):
    """The rows as Parquet files in time order, read one file per trigger. A last
    far event moves the watermark past all others."""
    edges = df.select(F.percentile(F.unix_micros("event_time"), [i / batches for i in
                                                                 range(1, batches)])).first()[0]
    part = sum((F.unix_micros("event_time") > edge).cast("int") for edge in edges)
    for number in range(batches):
        df.where(part == number).coalesce(1).write.mode("append").parquet(folder)
    flush = df.limit(1).withColumns({
        "user_uuid": F.lit("flush"), "event_name": F.lit("flush"),
        "event_time": F.lit("2030-01-01").cast("timestamp"),
        "event_local": F.lit("2030-01-01").cast("timestamp_ntz")})
    flush.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, stream, name, tmp_path):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "checkpoint")).start())
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_bursts_as_in_batch(spark, tmp_path):
    events = with_copies(load_events(spark, SF_DIR))
    stream = as_stream(spark, events, str(tmp_path / "in"))
    out = run(spark, remove_bursts_stream(stream, "1 minute"), "bursts", tmp_path)
    out = out.where("user_uuid <> 'flush'")
    batch = cleaning.remove_bursts(events)
    assert out.columns == batch.columns
    assert out.count() == batch.count()
    assert out.select("event_pos").exceptAll(batch.select("event_pos")).count() == 0


def test_incomplete_rows_pass_through(spark, tmp_path):
    events = event(spark, (None, "tap", "2026-01-05 10:00:00"),
                   (None, "tap", "2026-01-05 10:00:00.01"), ("u", None, "2026-01-05 10:00:00"),
                   ("u", "tap", "2026-01-05 10:00:00"), ("u", "tap", "2026-01-05 10:00:00.01"))
    folder = str(tmp_path / "in")
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    out = run(spark, remove_bursts_stream(stream, "0 seconds"), "incomplete", tmp_path)
    assert sorted(r.event_pos for r in out.where("user_uuid is null or event_name is null")
                  .collect()) == [0, 1, 2]


def test_sessions_as_in_batch(spark, tmp_path):
    events = load_events(spark, SF_DIR)
    stream = as_stream(spark, events, str(tmp_path / "in"))
    out = run(spark, session_summary_stream(stream, "1 minute"), "sessions", tmp_path)
    out = out.where("user_uuid <> 'flush'")
    batch = sessions.session_summary(events).drop("session_id")
    assert out.count() == batch.count()
    assert out.select(batch.columns).exceptAll(batch).count() == 0


def test_no_event_of_a_known_user_is_lost(spark):
    rows = [("u", 10), ("u", 4000), ("u", None), ("u", None), ("v", None), (None, 5), (None, None)]
    events = spark.createDataFrame(rows, "user_uuid string, s long").select(
        "user_uuid", F.timestamp_seconds("s").alias("event_time"),
        F.timestamp_seconds("s").cast("timestamp_ntz").alias("event_local"))
    counted = session_summary_stream(events).agg(F.sum("event_count")).first()[0]
    assert (counted, timeless_events_stream(events).count()) == (2, 3)


def files_in_time_order(df, folder, count=4):
    part = F.ntile(count).over(W.orderBy("event_time", "event_pos"))
    for number in range(1, count + 1):
        df.withColumn("_part", part).where(F.col("_part") == number).drop("_part").coalesce(1).write.mode(
            "append").parquet(folder)


def stop_after_first_batch(query):
    while query.lastProgress is None:
        time.sleep(0.1)
    query.stop()


def test_bursts_after_a_stop_and_a_restart(spark, tmp_path):
    events = with_copies(load_events(spark, SF_DIR))
    files_in_time_order(events, str(tmp_path / "in"))
    stream = finite.file_events(spark, str(tmp_path / "in"), events.schema, max_files=1)
    kept = remove_bursts_stream(finite.with_end(stream, str(tmp_path / "end")), "1 minute")
    checkpoint, out = str(tmp_path / "checkpoint"), str(tmp_path / "out")
    stop_after_first_batch(kept.writeStream.option("checkpointLocation", checkpoint).start(out))
    assert spark.read.schema(events.schema).parquet(out).count() < 600
    finite.run_to_end(stream, str(tmp_path / "end"), lambda: finite.available_now(kept, checkpoint).start(out))
    found = spark.read.schema(events.schema).parquet(out)
    batch = cleaning.remove_bursts(events)
    assert found.count() == batch.count()
    assert found.exceptAll(batch).count() == 0


@pytest.fixture
def some_sessions(spark):
    """Sessions of three users over many hours, and events without a time, before and after others."""
    rows = [("u", 60 * k * (1 + k % 50)) for k in range(120)] + [("v", 7000 * k) for k in range(30)]
    rows += [("u", None), ("u", None), ("w", None), (None, 5), (None, None), ("v", None)]
    return spark.createDataFrame(rows, "user_uuid string, s long").select(
        "user_uuid", F.lit("tap").alias("event_name"), F.timestamp_seconds("s").alias("event_time"),
        F.timestamp_seconds("s").cast("timestamp_ntz").alias("event_local"),
        F.xxhash64("user_uuid", "s").alias("event_pos"))


def plain(df):
    return sorted(map(str, (tuple(row) for row in df.select(sorted(df.columns)).collect())))


@pytest.mark.parametrize("totals_every", [20, 2])
def test_session_numbers_over_batches(spark, tmp_path, some_sessions, monkeypatch, totals_every):
    monkeypatch.setattr(numbering, "TOTALS_EVERY", totals_every)
    files_in_time_order(some_sessions, str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    stream = finite.file_events(spark, str(tmp_path / "in"), some_sessions.schema, max_files=1)
    ended = finite.with_end(stream, str(tmp_path / "end"))
    finite.run_to_end(stream, str(tmp_path / "end"),
                      lambda: numbering.start_numbering(ended, folder, "1 minute"))
    expected = plain(sessions.session_summary(some_sessions))
    assert plain(numbering.numbered_sessions(spark, folder)) == expected
    # A batch that runs again, as after a failure between its end and its commit, changes nothing.
    batches = sorted(int(path.name) for path in (tmp_path / "out" / "finished").iterdir())
    assert len(batches) >= 4 and (tmp_path / "out" / "totals").exists() == (totals_every == 2)
    for batch_id in batches[-2:]:
        again = spark.read.parquet(f"{folder}/finished/{batch_id}")
        again.write.parquet(f"{folder}/again/{batch_id}")
        numbering.number_batch(spark.read.parquet(f"{folder}/again/{batch_id}"), batch_id, folder)
        assert plain(numbering.numbered_sessions(spark, folder)) == expected


def test_streams_of_no_events(spark, tmp_path, some_sessions):
    folder = str(tmp_path / "out")
    some_sessions.limit(0).write.parquet(str(tmp_path / "in"))
    stream = finite.file_events(spark, str(tmp_path / "in"), some_sessions.schema)
    ended = finite.with_end(stream, str(tmp_path / "end"))
    finite.run_to_end(stream, str(tmp_path / "end"), lambda: numbering.start_numbering(ended, folder))
    assert numbering.numbered_sessions(spark, folder).collect() == []
