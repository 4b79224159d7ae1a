"""Numbering the events of each user without one task per user.

Events are range-partitioned by their full order, which cuts a heavy user, a crowded slot and even the
copies of one instant, and stored. Spark's row ids then number them: the upper bits are the
partition, the lower ones the place in it. What is left to find is how many events of a user lie
in earlier partitions, one small row per user and partition.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventloom.functions import times
from eventloom.operators.cleaning import remove_bursts
from eventloom.sources.shared import in_order

SLOT_SECONDS = 600

# The slot of events without a time, which come last.
TIMELESS_FROM = 1 << 60

# Fixed value: Spark's row ids have the partition above so many bits.
ROW_BITS = 33


def slot_seconds(gap_minutes=None) -> int:
    """Widest slot that divides a day and is not longer than the session gap, so
    a slot never crosses midnight and never holds a session break inside."""
    limit = SLOT_SECONDS
    if gap_minutes is not None:
        if gap_minutes < 0:
            raise ValueError("gap_minutes must not be negative")
        limit = max(1, min(limit, int(gap_minutes * 60)))
    return max(n for n in range(1, limit + 1) if times.SECONDS_PER_DAY % n == 0)


def total_order(time: str):
    """User, time, name and source position; rows without one of them last."""
    return [F.col(name).asc_nulls_last()
            for name in ("user_uuid", time, "event_name", "event_pos")]


def slot_of(seconds: Column, width: int) -> Column:
    """Start of the slot."""
    return F.coalesce(times.floor_to(seconds, width), F.lit(TIMELESS_FROM))


def first_row() -> Column:
    """Aggregate over consecutive rows."""
    return F.min("_row").alias("_first_row")


def timeline(events: DataFrame, threshold_ms=None) -> DataFrame:
    """Add ``sequence``, the place of each event among those of its user by
    instant, event name and source position. Events without a user are one group.

    Cleaned events hold no bursts, so none are looked for unless a threshold is
    given.
    """
    if threshold_ms is not None:
        events = remove_bursts(events, threshold_ms)
    rows = in_order(events, *total_order("event_time"))
    earlier = W.partitionBy("_user").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)
    pieces = rows.groupBy(F.col("user_uuid").alias("_user"), F.col("_part").alias("_in")).agg(
        F.count(F.lit(1)).alias("_n"), first_row())
    shifts = pieces.select("_user", "_in", (
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first_row")).alias("_shift"))
    same = (F.col("_part") == F.col("_in")) & F.col("user_uuid").eqNullSafe(F.col("_user"))
    return rows.join(shifts, same).select(
        *events.columns, (F.col("_row") + F.col("_shift")).alias("sequence"))
