import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import ordering, sessions
from eventloom.sources import shared
from tests.support import event

D = "2026-01-05 "


def ids(df, **kwargs):
    rows = sessions.number_events(df, **kwargs).orderBy("sequence").collect()
    return [r.session_id for r in rows]


def test_gap_counts_whole_seconds(spark):
    assert ids(event(spark, ("u", "a", D + "10:00:00"), ("u", "b", D + "10:30:00.9"))) == [1, 1]
    assert ids(event(spark, ("u", "a", D + "10:00:00.9"), ("u", "b", D + "10:30:00.1"))) == [1, 1]
    assert ids(event(spark, ("u", "a", D + "10:00:00"), ("u", "b", D + "10:30:01"))) == [1, 2]


def test_midnight_always_splits(spark):
    df = event(spark, ("u", "a", D + "23:50:00"), ("u", "b", "2026-01-06 00:05:00"))
    assert ids(df) == [1, 2]
    assert ids(df, gap_minutes=10_000) == [1, 2]


def test_rows_without_time_stay_in_the_running_session(spark):
    df = event(spark, ("u", "a", None), ("u", "b", D + "10:00:00"), ("u", "c", D + "12:00:00"))
    rows = sessions.number_events(df).orderBy("sequence").collect()
    assert [(r.event_name, r.session_id) for r in rows] == [("b", 1), ("c", 2), ("a", 2)]
    only = event(spark, ("u", "a", None), ("u", "b", None))
    assert ids(only) == [1, 1]


def test_rows_without_user_have_no_session(spark):
    df = event(spark, (None, "a", D + "10:00:00"), ("u", "b", D + "10:00:00"))
    assert ids(df) == [1]


def test_nodes_go_on_in_the_next_session(spark):
    rows = [("u", "e", f"{D}10:00:{i % 60:02d}.{i // 60}") for i in range(51)]
    df = event(spark, *rows, ("u", "late", D + "12:00:00"))
    numbered = sessions.number_events(df).orderBy("sequence").collect()
    assert [r.node_sequence for r in numbered] == [*range(1, 51), None, 51]
    assert {r.session_count for r in numbered} == {2}


def test_preview_shows_six(spark):
    df = event(spark, *[("u", f"e{i}", f"{D}10:00:0{i}") for i in range(8)])
    row = sessions.session_preview(sessions.number_events(df)).first()
    assert [e["name"] for e in row.events] == [f"e{i}" for i in range(6)]
    assert (row.event_count, row.more_events) == (8, 2)


def test_slots_divide_the_day_and_fit_the_gap():
    assert ordering.slot_seconds() == 600
    assert ordering.slot_seconds(30) == 600
    assert ordering.slot_seconds(7) == 400
    assert ordering.slot_seconds(0) == 1
    assert ordering.slot_seconds(0.5) == 30
    with pytest.raises(ValueError):
        ordering.slot_seconds(-1)


def brute_force(rows, gap_minutes, nodes):
    out, state = {}, {}
    for user, name, local, position in sorted(rows, key=lambda r: (r[2], r[1], r[3])):
        s = state.setdefault(user, {"last": None, "seq": 0, "sid": 0, "rank": 0, "node": 0})
        second = local.replace(microsecond=0)
        if (s["last"] is None or s["last"].date() != second.date()
                or (second - s["last"]).total_seconds() > gap_minutes * 60):
            s["sid"] += 1
            s["rank"] = 0
        s["seq"] += 1
        s["rank"] += 1
        if s["rank"] <= nodes:
            s["node"] += 1
        s["last"] = second
        out[position] = (s["seq"], s["sid"], s["rank"],
                         s["node"] if s["rank"] <= nodes else None)
    return out


@pytest.mark.parametrize("gap_minutes", [0, 0.5, 7, 30, 90, 3000])
def test_against_brute_force(spark, gap_minutes):
    rng = random.Random(gap_minutes)
    clock = datetime.datetime(2026, 1, 5, 20)
    rows = []
    for position in range(500):
        gap = gap_minutes * 60
        clock += datetime.timedelta(
            seconds=rng.choice([0, 1, gap / 3, gap, gap + 1, 400, 1200]),
            microseconds=rng.choice([0, 0, 1, 999_999]))
        rows.append((rng.choice("ab"), rng.choice("xyz"), clock, position))
    df = spark.createDataFrame(
        rows, "user_uuid string, event_name string, event_local timestamp_ntz, event_pos bigint")
    expected = brute_force(rows, gap_minutes, 3)
    numbered = sessions.number_events(df, gap_minutes, 3).collect()
    assert {r.event_pos: (r.sequence, r.session_id, r.session_sequence, r.node_sequence)
            for r in numbered} == expected
    summary = sessions.session_summary(df, gap_minutes)
    assert summary.agg(F.sum("event_count")).first()[0] == len(rows)
    assert summary.count() == len({(r.user_uuid, r.session_id) for r in numbered})


def test_same_sessions_as_session_windows(spark):
    """The built-in session window gives the same sessions day by day."""
    from eventloom.sources.tables import load_events
    from tests.support import TESTDATA

    events = load_events(spark, f"{TESTDATA}/sf0.001")
    built_in = (
        events.withColumn("second", F.date_trunc("second", "event_time"))
        .groupBy("user_uuid", F.col("event_local").cast("date"),
                 F.session_window("second", "30 minutes")).count())
    assert built_in.count() == sessions.session_summary(events).count()


def test_copies_and_rows_without_time_are_numbered_in_order(spark):
    """Unnamed copies crowd one instant of one user; even they are cut into parts."""
    n = 4000
    row = F.col("id")
    micros = F.lit(1_767_600_000_000_000) + F.when(row % 3 > 0, 0).otherwise(row * 2_000_000)
    events = spark.range(n).select(
        F.lit("u").alias("user_uuid"),
        F.when(row % 5 == 0, F.concat(F.lit("n"), row % 7)).alias("event_name"),
        F.timestamp_micros(micros).alias("event_time"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("event_local"),
        row.alias("event_pos"))
    timeless = events.where("event_pos < 300").withColumns({
        "event_time": F.lit(None).cast("timestamp"),
        "event_local": F.lit(None).cast("timestamp_ntz"), "event_pos": F.col("event_pos") + n})
    events = events.unionByName(timeless)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = shared.in_order(events, *ordering.total_order("event_time")).groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1.5 * events.count() / 4
    order = sorted(events.collect(), key=lambda r: (
        r.event_local is None, r.event_local, r.event_name is None, r.event_name or "", r.event_pos)
        if r.event_local else (True, 0, r.event_name is None, r.event_name or "", r.event_pos))
    expected = {r.event_pos: place for place, r in enumerate(order, 1)}
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            for numbered in (sessions.number_events(events), ordering.timeline(events)):
                assert {r.event_pos: r.sequence for r in numbered.collect()} == expected
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by_struct = events.withColumn("event_pos", F.struct(F.lit("f").alias("file"), "event_pos"))
    assert {r.event_pos.event_pos: r.sequence for r in ordering.timeline(by_struct).collect()} == expected
