"""Exact distinct users over any range of days, from small tables that are kept up to date.

Users get numbers once. A table then has, per day and bucket of user numbers, a bitmap of the users seen
and the number of events; a range of days is the union of its bitmaps. A new log adds rows and
never changes old ones, and no event is read again.
"""

from pyspark.sql import DataFrame, functions as F

from eventloom.operators.ordering import ROW_BITS
from eventloom.operators.users import known_users
from eventloom.sources.shared import in_order


def numbered_users(events: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(user_uuid, number) of the users in ``events`` that have no number yet.

    Numbers are consecutive within a partition of the sorted users, so that bitmaps are full;
    those of a later log begin above all before."""
    fresh = known_users(events)
    first = F.lit(0).cast("bigint")
    if numbers is not None:
        fresh = fresh.join(numbers, "user_uuid", "left_anti")
        last = numbers.agg(F.max("number")).first()[0]  # one number
        first = F.lit(0 if last is None else ((last >> ROW_BITS) + 1) << ROW_BITS).cast("bigint")
    return in_order(fresh, "user_uuid").select("user_uuid", (F.col("_row") + first).alias("number"))


def user_days(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """(event_date, bucket, users, event_count): a bitmap per day and bucket of numbers. Events without
    a user have the bucket null and no bitmap, events without a time the date null."""
    dated = events.select("user_uuid", F.col("event_local").cast("date").alias("event_date"))
    # Counted first, so that a user with many events meets its number once a day.
    counted = dated.groupBy("user_uuid", "event_date").agg(F.count(F.lit(1)).alias("event_count"))
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return counted.join(numbers, "user_uuid", "left").groupBy("event_date", bucket).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users"),
        F.sum("event_count").alias("event_count"))


def metrics_of_days(days: DataFrame, *groups) -> DataFrame:
    """Users and events over the days at hand, by any columns made from ``event_date``; one row without
    any. ``total_unique_users`` counts events without a user as one user, ``total_users`` does not."""
    names = [f"_group{k}" for k in range(len(groups))]
    keyed = days.select(*[g.alias(n) for g, n in zip(groups, names)], "bucket", "users", "event_count")
    united = keyed.groupBy(*names, "bucket").agg(
        F.when(F.col("bucket").isNotNull(), F.bitmap_count(F.bitmap_or_agg("users"))).alias("_users"),
        F.sum("event_count").alias("_events"))
    users = F.coalesce(F.sum("_users"), F.lit(0)).cast("bigint")
    nobody = F.count_if(F.col("bucket").isNull())
    return united.groupBy(*names).agg(
        users.alias("total_users"), (users + nobody).alias("total_unique_users"),
        F.coalesce(F.sum("_events"), F.lit(0)).cast("bigint").alias("total_events"))
