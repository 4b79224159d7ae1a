"""Properties of the physical plans and independence of the session zone."""

import re

import pytest
from pyspark.sql import Window as W, functions as F

from eventloom.operators import cleaning, ordering, sessions
from eventloom.plans.queries import QUERIES
from eventloom.sources.tables import load_events
from tests.support import TESTDATA, spark_rows

SF_DIR = f"{TESTDATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan(df))


def stored(spark, tmp_path):
    path = str(tmp_path / "events")
    load_events(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_burst_removal_shuffles_once_and_combines_before(spark):
    text = plan(cleaning.remove_bursts(load_events(spark, SF_DIR)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_min(" in text
    assert "Window" not in text and "Join" not in text


def test_user_filter_reaches_every_scan(spark, tmp_path):
    events = stored(spark, tmp_path)
    for df in (cleaning.remove_bursts(events), sessions.session_summary(events),
               sessions.number_events(events)):
        filters = pushed(df.where("user_uuid = '3'"))
        assert filters and all("EqualTo(user_uuid,3)" in f for f in filters)


def test_numbering_reads_its_source_once(spark, tmp_path):
    """The source is range-partitioned once and stored in order; what is returned reads that twice, and
    beside the range exchange there are the counts, the order of a user's slots and the join."""
    events = stored(spark, tmp_path)
    source = str(tmp_path)
    for df in (sessions.number_events(events), ordering.timeline(events), cleaning.event_gaps(events)):
        text = plan(df)
        assert text.count("Exchange") <= 4 and "SortAggregate" not in text
        assert text.count("FileScan") == 2 and source not in text
    slots = sessions.slot_counts(sessions.with_slot(events, 30))
    assert plan(slots).count("FileScan") == 1


def test_numbered_copies_keep_one_version(spark):
    """Row ids that would differ in a second reading are read from the stored table."""
    events = load_events(spark, SF_DIR)
    mixed = sessions.number_events(events.repartition(5, F.rand()))
    assert mixed.exceptAll(sessions.number_events(events)).count() == 0
    assert mixed.exceptAll(mixed).count() == 0


def test_summary_reads_only_what_it_needs(spark, tmp_path):
    text = plan(sessions.session_summary(stored(spark, tmp_path)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "user_uuid", "event_local"}


def test_event_filter_stays_above_sessions(spark, tmp_path):
    """Sessions depend on all events, so a filter on the name reaches the numbered rows but not what
    they are counted from; the burst rule compares equal names only, so there it may."""
    events = stored(spark, tmp_path)
    by_name = "event_name = 'click'"
    numbered = sessions.number_events(events)
    assert sorted("click" in f for f in pushed(numbered.where(by_name))) == [False, True]
    clicks = [r for r in numbered.collect() if r.event_name == "click"]
    assert sorted(clicks, key=str) == sorted(numbered.where(by_name).collect(), key=str)
    assert all("click" in f for f in pushed(cleaning.remove_bursts(events).where(by_name)))


def test_no_operator_runs_python_or_nested_loops(spark):
    for name, query in QUERIES.items():
        text = plan(query(spark, SF_DIR))
        for banned in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
            if banned == "SinglePartition" and name in (
                    "unique_users_count", "global_metrics", "february_users"):
                continue  # one-row reports
            assert banned not in text, name


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_zone(spark, zone):
    names = ["event_calendar", "dedup_clean", "daily_repetition", "session_summary",
             "burst_audit", "journey_events"]
    before = {name: spark_rows(QUERIES[name](spark, SF_DIR)) for name in names}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in names:
            assert spark_rows(QUERIES[name](spark, SF_DIR)) == before[name], name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hour_lost_to_daylight_saving(spark):
    from eventloom.functions import times

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        local = F.lit("2024-03-10 02:30:00.5").cast("timestamp_ntz")
        row = spark.range(1).select(
            times.date_time_text(local), times.weekday_name(local), times.second_of_day(local),
            times.local_micros(local)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2024-03-10 02:30:00.500000", "Sunday", 9000, 1710037800500000)


def test_heavy_keys_spread_over_tasks(spark):
    """A third of the rows belongs to one user, a third are copies of one event;
    the work still spreads evenly."""
    n = 60_000
    row = F.col("id")
    user = F.when(row % 3 == 0, "hot").when(row % 3 == 1, "copied").otherwise(
        F.concat(F.lit("u"), row % 5000))
    micros = F.when(row % 3 == 1, F.lit(0)).otherwise(row * 1_300_000)
    events = spark.range(n).select(
        user.alias("user_uuid"), F.lit("e").alias("event_name"), F.lit("Application").alias("category"),
        F.timestamp_micros(micros).alias("event_time"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("event_local"),
        F.lit("+00:00").alias("event_offset"), row.alias("event_pos"))
    clean = cleaning.remove_bursts(events)
    assert clean.count() == 2 * n // 3 + 1
    slots = sessions.with_slot(clean, 30).groupBy("user_uuid", "_slot").count()
    assert slots.agg(F.max("count")).first()[0] < 200
    per_task = (
        sessions.with_slot(clean, 30).repartition(8, "user_uuid", "_slot")
        .groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.avg("count")).first())
    assert per_task[0] < 2 * per_task[1]
    whole = W.partitionBy("user_uuid").orderBy("event_local", "event_pos")
    numbered = sessions.number_events(clean)
    wrong = numbered.withColumn("expected", F.row_number().over(whole)).where("expected <> sequence")
    assert wrong.count() == 0


@pytest.mark.parametrize("name, scans", [("flowchart_text", 1), ("ai_payload", 1), ("session_events", 0)])
def test_scans_of_the_source(spark, name, scans):
    """Beside the pass that puts the events in order, and for payloads one that counts repetition."""
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("events.parquet") == scans
