import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import audit, cleaning, ordering, users
from tests.support import event

D = "2026-01-05 "


def kept(df, threshold_ms=50):
    rows = cleaning.remove_bursts(df, threshold_ms).select("event_pos").collect()
    by_gap = cleaning.event_gaps(df).where(cleaning.is_canonical(threshold_ms))
    assert sorted(r[0] for r in rows) == sorted(
        r[0] for r in by_gap.select("event_pos").collect())
    return sorted(r[0] for r in rows)


def burst(*times, user="u1", name="tap"):
    return [(user, name, t if t is None or t.startswith("2026") else D + t) for t in times]


def test_chain_collapses_to_its_first_event(spark):
    df = event(spark, *burst("10:00:00", "10:00:00.04", "10:00:00.08", "10:00:00.12"))
    assert kept(df) == [0]


def test_gap_equal_to_the_threshold_is_a_repeat(spark):
    df = event(spark, *burst("10:00:00", "10:00:00.05"),
               *burst("11:00:00", "11:00:00.050001"))
    assert kept(df) == [0, 2, 3]


def test_other_event_between(spark):
    df = event(spark, *burst("10:00:00"), *burst("10:00:00.01", name="view"),
               *burst("10:00:00.02"))
    assert kept(df) == [0, 1]


def test_burst_across_midnight(spark):
    df = event(spark, *burst("23:59:59.99", "2026-01-06 00:00:00.01"))
    assert kept(df) == [0]
    assert audit.daily_repetition(df).count() == 0
    assert audit.daily_repetition(df, repeated_only=False).count() == 2


def test_repetition_counts_all_rows_of_a_day(spark):
    df = event(spark, *burst("09:00:00", "10:00:00", name="login"))
    assert kept(df) == [0, 1]
    row = audit.daily_repetition(df).first()
    assert (row.frequency, row.repetitions_removed) == (2, 1)
    assert (row.start_time, row.end_time) == ("09:00:00.000000", "10:00:00.000000")
    assert (row.event_date, row.event_day) == ("2026-01-05", "Monday")
    assert [r.removed for r in audit.burst_audit(df).collect()] == [0, 0]


def test_rows_without_user_or_name_or_time_are_kept(spark):
    df = event(spark, *burst("10:00:00", "10:00:00.01", user=None),
               *burst("10:00:00", "10:00:00.01", name=None), *burst(None, None))
    assert kept(df) == [0, 1, 2, 3, 4, 5]
    assert audit.daily_repetition(df).count() == 0
    assert audit.burst_audit(df).count() == 0
    assert users.unique_users_count(df).first().value == 2
    assert users.global_metrics(df).first().total_users == 1


def test_rows_without_time_sort_last(spark):
    df = event(spark, *burst(None, "10:00:00"))
    rows = ordering.timeline(cleaning.cleaned_events(df)).orderBy("sequence").collect()
    assert [r.event_pos for r in rows] == [1, 0]
    assert (rows[1].event_date, rows[1].event_day, rows[1].event_time_only) == (None, None, None)


def test_ties_come_by_name_then_position(spark):
    df = event(spark, *burst("10:00:00", name="b"), *burst("10:00:00", name="a"))
    rows = ordering.timeline(df).orderBy("sequence").collect()
    assert [r.event_name for r in rows] == ["a", "b"]


def test_first_of_equal_times_is_first_in_the_source(spark):
    df = event(spark, ("u1", "tap", D + "10:00:00", "x", 9), ("u1", "tap", D + "10:00:00", "y", 3))
    assert cleaning.remove_bursts(df).first().category == "y"


def test_times_before_1970(spark):
    df = event(spark, ("u", "e", "1969-12-31 23:59:59.99"), ("u", "e", "1970-01-01 00:00:00.01"),
               ("u", "e", "1969-12-31 12:00:00"))
    assert kept(df) == [0, 2]
    assert audit.burst_audit(df).count() == 2


def test_threshold_zero_removes_exact_copies_only(spark):
    df = event(spark, *burst("10:00:00", "10:00:00", "10:00:00.000001"))
    assert kept(df, 0) == [0, 2]
    with pytest.raises(ValueError):
        cleaning.remove_bursts(df, -1)


def test_extra_columns_pass_through(spark):
    df = event(spark, *burst("10:00:00", "10:00:00.01")).withColumn("extra", F.lit("x"))
    out = cleaning.remove_bursts(df)
    assert out.columns == df.columns
    assert out.first().extra == "x"


def brute_force(rows, limit_us):
    """Position of kept rows and (size of each burst) by plain loops."""
    groups = {}
    for user, name, us, position in sorted(rows, key=lambda r: (r[2], r[3])):
        groups.setdefault((user, name), []).append((us, position))
    kept_rows, sizes = [], []
    for members in groups.values():
        last = None
        for us, position in members:
            if last is None or us - last > limit_us:
                kept_rows.append(position)
                sizes.append(0)
            sizes[-1] += 1
            last = us
    return sorted(kept_rows), sorted(sizes)


@pytest.mark.parametrize("threshold_ms", [0, 0.003, 50, 60_000])
def test_against_brute_force(spark, threshold_ms, monkeypatch):
    monkeypatch.setattr(audit, "CELLS_PER_BLOCK", 3)
    rng = random.Random(threshold_ms)
    step = max(1, int(threshold_ms * 1000))
    us = 1_700_000_000_000_000
    rows = []
    for position in range(600):
        us += rng.choice([0, 1, step // 2, step - 1, step, step + 1, 2 * step, 50 * step])
        rows.append((rng.choice("ab"), rng.choice("xy"), us, position))
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, "user_uuid string, event_name string, us bigint, event_pos bigint").select(
        "user_uuid", "event_name", F.timestamp_micros("us").alias("event_time"), "event_pos")
    expected, sizes = brute_force(rows, int(threshold_ms * 1000))
    assert kept(df, threshold_ms) == expected
    bursts = audit.burst_audit(df, threshold_ms).collect()
    assert sorted(r.burst_size for r in bursts) == sizes
    again = cleaning.remove_bursts(cleaning.remove_bursts(df, threshold_ms), threshold_ms)
    assert again.count() == len(expected)
    assert sum(r.removed for r in bursts) == len(rows) - len(expected)
