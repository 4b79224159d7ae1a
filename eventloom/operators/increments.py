"""Burst removal and repetition from tables that a new log is merged into.

What earlier logs leave behind is one row per cell of burst removal (its first event and its last
time) and one per user, event and day of the repetition. Both merge in any order, so late
events are no special case: they may make a kept event a repeat, or open a burst anew.
"""

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import times
from eventloom.operators import audit
from eventloom.operators.cleaning import KEYS, first_of_bursts, is_keyless, threshold_micros, whole_row
from eventloom.schema import BURST_MS, REPETITION_SCHEMA

# The cell first, so that sorting by the keys compares numbers.
CELL_KEYS = ["_cell", *KEYS, "_alone"]
REPETITION_KEYS = [*KEYS, "event_date", "event_day"]
MICROS_PER_DAY = times.SECONDS_PER_DAY * 1_000_000


def burst_cells(events: DataFrame, threshold_ms=BURST_MS) -> DataFrame:
    """(user_uuid, event_name, _alone, _cell, first, last, day): the cells of ``remove_bursts``, ``day`` the
    number of the day since 1970 in which the cell begins. Events without user, name or time have
    cells of their own."""
    width = threshold_micros(threshold_ms) + 1
    rows = events.select(
        *KEYS, "event_time", whole_row(events), F.when(is_keyless(), F.col("event_pos")).alias("_alone"),
        times.floor_to(F.coalesce(F.unix_micros("event_time"), F.lit(0)), width).alias("_cell"))
    cells = rows.groupBy(*CELL_KEYS).agg(F.min("_row").alias("first"), F.max("event_time").alias("last"))
    day = (times.floor_to(F.col("_cell"), MICROS_PER_DAY) / MICROS_PER_DAY).cast("bigint")
    return cells.select(*KEYS, "_alone", "_cell", "first", "last", day.alias("day"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """One row per cell from those of several logs."""
    return cells.groupBy("day", *CELL_KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last")).select(
        *KEYS, "_alone", "_cell", "first", "last", "day")


def kept_of_cells(cells: DataFrame, threshold_ms=BURST_MS) -> DataFrame:
    """The events that ``remove_bursts`` keeps of all logs whose merged cells are given."""
    width = threshold_micros(threshold_ms) + 1
    halves = F.posexplode(F.array(F.col("_cell"), F.col("_cell") + width)).alias("_half", "_in")
    rows = cells.select(*KEYS, "_alone", F.col("first").alias("_row"), F.col("last").alias("event_time"), halves)
    return first_of_bursts(rows.withColumn("_own", F.col("_half") == 0), threshold_ms, ["_in", *KEYS, "_alone"])


def repetition_days(events: DataFrame) -> DataFrame:
    """All rows of ``daily_repetition``, with the number of the day."""
    return audit.daily_repetition(events, repeated_only=False).withColumn(
        "day", F.datediff(F.col("event_date").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint"))


def merged_repetition(days: DataFrame) -> DataFrame:
    """One row per user, event and day from those of several logs."""
    total = F.sum("frequency")
    return days.groupBy("day", *REPETITION_KEYS).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        total.alias("frequency"), (total - 1).alias("repetitions_removed")).select(*REPETITION_SCHEMA.fieldNames(), "day")
