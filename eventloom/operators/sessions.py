"""Sessions: runs of events of one user on one day with no gap above a limit.

Gaps count whole seconds, and a new day always starts a new session.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import times
from eventloom.operators.ordering import first_row, slot_of, slot_seconds, total_order
from eventloom.operators.parts import in_sequence, part_of
from eventloom.operators.users import with_known_users
from eventloom.schema import ITEMS_PER_PART, NODES_PER_SESSION, SESSION_GAP_MINUTES
from eventloom.sources.shared import in_order

# Fixed value: events shown in a preview.
PREVIEW_EVENTS = 6


def with_slot(events: DataFrame, gap_minutes) -> DataFrame:
    seconds = times.local_seconds(F.col("event_local"))
    return events.where(F.col("user_uuid").isNotNull()).withColumn(
        "_slot", slot_of(seconds, slot_seconds(gap_minutes)))


def slot_counts(rows: DataFrame, *more_keys, also=()) -> DataFrame:
    """Events and first and last time per (user, slot)."""
    return rows.groupBy("user_uuid", "_slot", *more_keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("event_local").alias("_first"), F.max("event_local").alias("_last"), *also)


def session_slots(slots: DataFrame, gap_minutes=SESSION_GAP_MINUTES,
                  max_nodes=NODES_PER_SESSION, *more_order) -> DataFrame:
    """The rows of ``slot_counts`` with their session and the totals before it.

    A slot is too short to hold a session break, so the session of all its
    events follows from the first and last event of each slot.
    """
    by_slot = W.partitionBy("user_uuid").orderBy("_slot", *more_order)
    so_far = by_slot.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("user_uuid")
    session = W.partitionBy("user_uuid", "session_id")
    last = F.lag("_last").over(by_slot)
    gap = times.second_of_day(F.col("_first")) - times.second_of_day(last)
    breaks = ((F.col("_first").cast("date") != last.cast("date"))
              | (gap > F.lit(gap_minutes * 60)))
    is_new = (
        F.when(F.lag("_slot").over(by_slot).isNull(), 1)
        .when(breaks, 1).otherwise(0)  # no time: stays in the running session
    )
    kept = (F.least(F.lit(max_nodes), F.col("_rank_before") + F.col("_n"))
            - F.least(F.lit(max_nodes), F.col("_rank_before")))
    return (
        slots.withColumns({"_new": is_new, "_seq_before": F.sum("_n").over(so_far) - F.col("_n")})
        .withColumns({
            "session_id": F.sum("_new").over(so_far),
            "_session_from": F.max(F.when(F.col("_new") == 1, F.col("_seq_before"))).over(so_far)})
        .withColumn("_rank_before", F.col("_seq_before") - F.col("_session_from"))
        .withColumn("_kept", kept)
        .withColumns({
            "_node_before": F.sum("_kept").over(so_far) - F.col("_kept"),
            "session_count": F.max("session_id").over(whole),
            "session_size": F.sum("_n").over(session),
            "session_start": F.min("_first").over(session),
            "session_end": F.max("_last").over(session)})
        .drop("_new", "_session_from", "_kept")
    )


def number_events(events: DataFrame, gap_minutes=SESSION_GAP_MINUTES,
                  max_nodes=NODES_PER_SESSION) -> DataFrame:
    """Add to every event of a known user the columns the journey operators use:

    ``sequence``          place among the events of the user, by wall clock
    ``session_id``        session of the user, from 1
    ``session_sequence``  place within the session
    ``node_sequence``     place among the first ``max_nodes`` events of all
                          sessions of the user; null beyond those
    ``session_count``     sessions of the user
    ``session_size``      events of the session
    ``session_start``, ``session_end``  first and last time of the session
    """
    rows = in_order(with_slot(events, gap_minutes), *total_order("event_local"))
    # A slot has one row here per partition it lies in.
    keys = ["user_uuid", "_slot", "_part"]
    slots = session_slots(slot_counts(rows, "_part", also=[first_row()]), gap_minutes, max_nodes, "_part")
    rank = F.col("_row") - F.col("_first_row") + 1
    place = F.col("_rank_before") + rank
    return rows.join(slots.drop("_n", "_first", "_last"), keys).select(
        *events.columns,
        (F.col("_seq_before") + rank).alias("sequence"),
        "session_id",
        place.alias("session_sequence"),
        F.when(place <= max_nodes, F.col("_node_before") + rank).alias("node_sequence"),
        "session_count", "session_size", "session_start", "session_end",
    )


def summary_columns(first, last):
    return [times.date_text(first).alias("session_date"),
            times.clock_seconds(first).alias("start_time"),
            times.clock_seconds(last).alias("end_time")]


def session_summary(events: DataFrame, gap_minutes=SESSION_GAP_MINUTES) -> DataFrame:
    """Date, first and last time and number of events of every session. It needs
    the slots only, never the single events in order."""
    return (
        session_slots(slot_counts(with_slot(events, gap_minutes)), gap_minutes)
        .groupBy("user_uuid", "session_id")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"),
             F.sum("_n").alias("event_count"))
        .select("user_uuid", "session_id",
                *summary_columns(F.col("_first"), F.col("_last")), "event_count")
    )


def sessions_per_user(events: DataFrame, gap_minutes=SESSION_GAP_MINUTES,
                      users: DataFrame | None = None) -> DataFrame:
    """Number of sessions; with users, also for those who have no events, with 0."""
    slots = slot_counts(with_slot(events, gap_minutes))
    counts = session_slots(slots, gap_minutes).groupBy("user_uuid").agg(
        F.max("session_id").alias("session_count"))
    return with_known_users(counts, users, ["session_count"])


def event_item():
    return F.struct(
        F.col("event_name").alias("name"),
        times.clock_seconds(F.col("event_local")).alias("time"),
        "category",
    )


def with_events(numbered: DataFrame, *more_keys) -> DataFrame:
    """Session summary with the events at hand of every session as an array."""
    return (
        numbered
        .groupBy("user_uuid", "session_id", *more_keys, "session_start", "session_end",
                 "session_size")
        .agg(in_sequence(F.col("session_sequence"), event_item()).alias("events"))
        .withColumnRenamed("session_size", "event_count")
    )


def session_cards(numbered: DataFrame, items_per_part=ITEMS_PER_PART) -> DataFrame:
    """Session summary with the events as an array. A session of more than
    ``items_per_part`` events continues in part 2, 3, ..."""
    part = part_of(F.col("session_sequence"), items_per_part).alias("part")
    return with_events(numbered, part).select(
        "user_uuid", "session_id", "part",
        *summary_columns(F.col("session_start"), F.col("session_end")), "event_count", "events")


def session_preview(numbered: DataFrame, shown=PREVIEW_EVENTS) -> DataFrame:
    """Session summary with the first few events and how many more there are."""
    return with_events(numbered.where(F.col("session_sequence") <= shown)).select(
        "user_uuid", "session_id",
        *summary_columns(F.col("session_start"), F.col("session_end")), "event_count", "events",
        F.greatest(F.col("event_count") - shown, F.lit(0)).alias("more_events"))


def session_labels(numbered: DataFrame) -> DataFrame:
    """``Session i: date (HH:MM - HH:MM)`` over the chart nodes of each session."""
    return (
        numbered.where(F.col("node_sequence").isNotNull())
        .groupBy("user_uuid", "session_id")
        .agg(F.min("event_local").alias("_first"), F.max("event_local").alias("_last"))
        .select("user_uuid", "session_id",
                session_label(F.col("session_id"), F.col("_first"), F.col("_last"))
                .alias("session_label"))
    )


def session_label(number, first, last):
    return F.concat(
        F.lit("Session "), number.cast("string"), F.lit(": "), times.date_text(first),
        F.lit(" ("), times.clock_minutes(first), F.lit(" - "), times.clock_minutes(last),
        F.lit(")"))
