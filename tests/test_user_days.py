from pyspark.sql import functions as F

from eventloom.operators import user_days
from tests.support import event

DAY = "2026-01-0"


def totals(days, *groups):
    return sorted(map(tuple, user_days.metrics_of_days(days, *groups).collect()), key=str)


def test_users_of_days_and_ranges(spark):
    rows = [(f"u{k % 7}", "a", f"{DAY}{1 + k % 3} 10:00:0{k % 10}") for k in range(40)]
    events = event(spark, *rows, (None, "a", f"{DAY}1 10:00:00"), (None, "b", f"{DAY}2 10:00:00"), ("late", "a", None))
    numbers = user_days.numbered_users(events)
    days = user_days.user_days(events, numbers)
    assert totals(days) == [(8, 9, 43)]
    assert totals(days.where("event_date is not null")) == [(7, 8, 42)]
    by_day = totals(days, F.col("event_date").cast("string"))
    assert {row[0]: row[1:] for row in by_day} == {
        None: (1, 1, 1), f"{DAY}1": (7, 8, 15), f"{DAY}2": (7, 8, 14), f"{DAY}3": (7, 7, 13)}


def test_a_later_log_adds_rows_only(spark):
    first = event(spark, *[(f"u{k}", "a", f"{DAY}1 10:00:00") for k in range(50)])
    second = event(spark, *[(f"u{k}", "a", f"{DAY}1 11:00:00") for k in range(30, 90)], (None, "a", f"{DAY}2 10:00:00"))
    numbers = user_days.numbered_users(first)
    more = user_days.numbered_users(second, numbers)
    both = numbers.unionByName(more)
    assert more.count() == 40 and both.select("number").distinct().count() == both.count() == 90
    days = user_days.user_days(first, both).unionByName(user_days.user_days(second, both))
    whole = first.unionByName(second)
    assert totals(days) == totals(user_days.user_days(whole, user_days.numbered_users(whole))) == [(90, 91, 111)]


def test_many_users_fill_several_buckets(spark):
    users = spark.range(100_000).select(
        F.concat(F.lit("u"), "id").alias("user_uuid"), F.lit("2026-01-05 10:00:00").cast("timestamp_ntz").alias("event_local"))
    days = user_days.user_days(users, user_days.numbered_users(users))
    assert 4 <= days.count() <= 12
    assert totals(days) == [(100_000, 100_000, 100_000)]


def test_no_events(spark):
    events = event(spark, ("u", "a", None)).limit(0)
    days = user_days.user_days(events, user_days.numbered_users(events))
    assert totals(days) == [(0, 0, 0)]
