"""Burst removal: an event is dropped when the same user sent the same event at
most ``threshold_ms`` earlier. Every event is compared with the one right before
it, kept or not, so a chain of short gaps collapses to its first event.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import times
from eventloom.schema import BURST_MS
from eventloom.sources.shared import in_order

KEYS = ["user_uuid", "event_name"]


def threshold_micros(threshold_ms) -> int:
    micros = round(threshold_ms * 1000)
    if micros < 0:
        raise ValueError("threshold_ms must not be negative")
    return micros


def remove_bursts(events: DataFrame, threshold_ms=BURST_MS) -> DataFrame:
    """Keep the first event of every burst, with all its columns.

    Time is cut into cells one microsecond wider than the threshold. Inside a
    cell only the first event can survive, and whether it does depends on the
    last event of the cell before alone: anything earlier is too far away. So
    every event counts once in its own cell and lends its time to the next, and
    the rule becomes one aggregation. Copies and dense bursts shrink before the
    shuffle, and a heavy (user, event) spreads over as many groups as it has
    cells, so no task depends on how rows fall on keys.

    Events without user, name or time have no predecessor and are all kept; each
    forms its own group.
    """
    width = threshold_micros(threshold_ms) + 1
    cell = times.floor_to(F.coalesce(F.unix_micros("event_time"), F.lit(0)), width)
    rows = events.select(
        *KEYS, "event_time", whole_row(events),
        F.when(is_keyless(), F.col("event_pos")).alias("_alone"),
        F.posexplode(F.array(cell, cell + width)).alias("_half", "_cell"))
    firsts = first_of_bursts(rows.withColumn("_own", F.col("_half") == 0), threshold_ms,
                             ["_cell", *KEYS, "_alone"])
    return firsts.select(*events.columns)


def whole_row(events: DataFrame):
    """All columns but the keys, in the order that decides which row is first.

    The keys stay plain grouping columns, so that a filter on the user of the
    result reaches the scan. Columns must be orderable, which maps are not.
    """
    order = ["event_time", "event_pos"]
    return F.struct(*order, *[c for c in events.columns if c not in KEYS + order]).alias("_row")


def is_keyless():
    return (F.col("user_uuid").isNull() | F.col("event_name").isNull()
            | F.col("event_time").isNull())


def first_of_bursts(rows: DataFrame, threshold_ms, group: list[str]) -> DataFrame:
    """The aggregation of ``remove_bursts``: ``_row`` is kept from rows in their
    own cell; the others only lend their time and travel without content. With
    the cell first among the keys, sorting by them compares numbers."""
    own, time = F.col("_own"), F.col("event_time")
    limit = F.expr(f"interval {threshold_micros(threshold_ms)} microseconds")
    firsts = rows.select(
        *group,
        F.when(own, F.col("_row")).alias("_row"),
        F.when(~own, time).alias("_before"),
    ).groupBy(*group).agg(
        F.min("_row").alias("_row"), F.max("_before").alias("_before"),
    )
    return firsts.where(
        F.col("_row").isNotNull()
        & (F.col("_before").isNull() | (F.col("_row.event_time") > F.col("_before") + limit))
    ).select(*KEYS, "_row.*")


def event_gaps(events: DataFrame) -> DataFrame:
    """Add ``gap_us``, the time since the previous event of the same user and
    name; null for the first one and for events without user, name or time.

    The events are cut into parts by their full order, which even cuts the copies of one instant.
    Each event looks back within its part; the first of a part takes the last time of the
    part before, one small row per user, name and part.
    """
    rows = in_order(events.withColumn("_us", F.unix_micros("event_time")),
                    *[F.col(name).asc_nulls_last() for name in (*KEYS, "_us", "event_pos")])
    lasts = rows.where(~is_keyless()).groupBy(*KEYS, "_part").agg(F.max("_us").alias("_last"))
    carried = lasts.select(
        *[F.col(name).alias(f"_of_{name}") for name in (*KEYS, "_part")],
        F.lag("_last").over(W.partitionBy(*KEYS).orderBy("_part")).alias("_carried"))
    in_part = W.partitionBy(*KEYS, "_part").orderBy("_row")
    same = [F.col(name) == F.col(f"_of_{name}") for name in (*KEYS, "_part")]
    gap = F.col("_us") - F.coalesce("_before", "_carried")
    return (
        rows.withColumn("_before", F.lag("_us").over(in_part)).join(carried, same, "left")
        .select(*events.columns, F.when(~is_keyless(), gap).cast("bigint").alias("gap_us"))
    )


def is_canonical(threshold_ms=BURST_MS):
    """The keep rule as a condition on the output of ``event_gaps``."""
    gap = F.col("gap_us")
    return gap.isNull() | (gap > threshold_micros(threshold_ms))


def cleaned_events(raw: DataFrame, threshold_ms=BURST_MS) -> DataFrame:
    """Burst removal plus the derived date, weekday and time columns."""
    return times.calendar(remove_bursts(raw, threshold_ms))
