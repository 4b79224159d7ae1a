"""Journeys: ordered event tables, transitions, chart nodes and nested records.

All operators here take the output of ``sessions.number_events``, so that events
are ordered once, stored if wished, and used many times.

Nested results are cut into numbered parts of bounded size, so that a user with
very many events is neither truncated nor gathered in one place. Most users have
a single part, which then is the whole journey.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import texts, times
from eventloom.operators import users as user_ops
from eventloom.operators.parts import in_sequence, part_of, with_parts
from eventloom.schema import ITEMS_PER_PART

# What joins the names of a path, and the path of a user without events.
ARROW = " -> "
EMPTY_PATH = "No events found for this user."


def journey_events(numbered: DataFrame) -> DataFrame:
    """Flat journey: one row per event with its sequence, session and calendar."""
    return times.calendar(numbered).select(
        "user_uuid", "sequence", "event_name", "category",
        F.col("event_date").alias("date"), F.col("event_day").alias("day"),
        times.strip_quotes(F.col("event_time_only")).alias("time"),
        "session_id", "session_sequence", "event_pos",
    )


def journey_path(numbered: DataFrame, items_per_part=ITEMS_PER_PART,
                 users: DataFrame | None = None) -> DataFrame:
    """Event names of a user joined by arrows. The parts of a user, joined by
    another arrow, are the whole path. With users, those who have no events get one part
    with 0 events and a note as its path."""
    paths = (
        numbered
        .groupBy("user_uuid", part_of(F.col("sequence"), items_per_part).alias("part"))
        .agg(in_sequence(F.col("sequence"), texts.shown_name(F.col("event_name"))).alias("_names"))
        .select("user_uuid", "part", F.size("_names").cast("bigint").alias("event_count"),
                F.array_join("_names", ARROW).alias("path"))
    )
    if users is None:
        return paths
    return user_ops.known_users(users).join(paths, "user_uuid", "left").select(
        "user_uuid", F.coalesce("part", F.lit(1).cast("bigint")).alias("part"),
        F.coalesce("event_count", F.lit(0).cast("bigint")).alias("event_count"),
        F.coalesce("path", F.lit(EMPTY_PATH)).alias("path"))


def session_path(numbered: DataFrame, items_per_part=ITEMS_PER_PART) -> DataFrame:
    """The same per session."""
    place = F.col("session_sequence")
    return (
        numbered
        .groupBy("user_uuid", "session_id", part_of(place, items_per_part).alias("part"))
        .agg(in_sequence(place, texts.shown_name(F.col("event_name"))).alias("_names"))
        .select("user_uuid", "session_id", "part",
                F.array_join("_names", ARROW).alias("path"))
    )


def journey_nodes(numbered: DataFrame) -> DataFrame:
    """Chart nodes: the first events of every session, as many as the numbering
    was told, numbered through all sessions of the user."""
    return (
        numbered
        .where(F.col("node_sequence").isNotNull())
        .select(
            "user_uuid", "session_id", "session_sequence", "node_sequence",
            F.concat(F.lit("N"), F.col("node_sequence").cast("string")).alias("node_id"),
            "event_name",
            texts.chart_label(texts.shown_name(F.col("event_name"))).alias("label"),
            "event_local", "session_count",
        )
    )


def transitions(numbered: DataFrame, items_per_part=ITEMS_PER_PART) -> DataFrame:
    """Every step from one event to the next within a session.

    A session is cut into runs of ``items_per_part`` events. The first event of
    a run is also the target of the last step of the run before, so it goes to
    both.
    """
    place = F.col("session_sequence")
    part = part_of(place, items_per_part)
    both = (place > 1) & ((place - 1) % items_per_part == 0)
    runs = numbered.select(
        "user_uuid", "session_id", "session_sequence", "event_name",
        F.explode(F.when(both, F.array(part - 1, part)).otherwise(F.array(part))).alias("_run"))
    in_run = W.partitionBy("user_uuid", "session_id", "_run").orderBy("session_sequence")
    following = F.lead(F.struct("event_name")).over(in_run)
    return (
        runs.withColumn("_next", following).where(F.col("_next").isNotNull())
        .select("user_uuid", "session_id", F.col("session_sequence").alias("step"),
                F.col("event_name").alias("from_event"),
                F.col("_next.event_name").alias("to_event"))
    )


def transition_counts(steps: DataFrame) -> DataFrame:
    """How often each step occurs, over all users."""
    return steps.groupBy("from_event", "to_event").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.countDistinct("user_uuid").alias("user_count"))


def journey_edges(numbered: DataFrame) -> DataFrame:
    """Chart edges between the nodes of ``journey_nodes``."""
    in_session = W.partitionBy("user_uuid", "session_id").orderBy("session_sequence")
    following = F.lead(F.struct("node_id", "event_name")).over(in_session)
    return (
        journey_nodes(numbered)
        .withColumn("_next", following).where(F.col("_next").isNotNull())
        .select("user_uuid", "session_id",
                F.col("node_id").alias("from_node"), F.col("_next.node_id").alias("to_node"),
                F.col("event_name").alias("from_event"),
                F.col("_next.event_name").alias("to_event"))
    )


def empty_like(df: DataFrame, array: str):
    return F.array().cast(df.schema[array].dataType)


def counts_as_map(counts: DataFrame, name: str, alias: str) -> DataFrame:
    """Counts per user as one map; it has an entry per distinct name."""
    entries = F.array_sort(F.collect_list(F.struct(name, "event_count")))
    return counts.groupBy("user_uuid").agg(F.map_from_entries(entries).alias(alias))


def journey_record(numbered: DataFrame, events: DataFrame, users: DataFrame | None = None,
                   items_per_part=ITEMS_PER_PART) -> DataFrame:
    """Nested journey with its metadata, one row per user and part. ``events`` are
    the events that were numbered. Users given but without events get an empty
    record."""
    flat = journey_events(numbered)
    parts = flat.groupBy("user_uuid", part_of(F.col("sequence"), items_per_part).alias("part")).agg(
        in_sequence(F.col("sequence"), F.struct(
            "sequence", "event_name", "category", "date", "day", "time")).alias("events"))
    metadata = F.struct(
        "total_events", "unique_event_types",
        F.struct("first_event", "last_event", "span_days").alias("date_range"),
        "event_categories", "event_breakdown",
    )
    per_user = (
        user_ops.user_metrics(events)
        .join(counts_as_map(user_ops.category_breakdown(events), "category",
                            "event_categories"), "user_uuid", "left")
        .join(counts_as_map(user_ops.event_breakdown(events), "event_name",
                            "event_breakdown"), "user_uuid", "left")
        .select("user_uuid", "total_events", "unique_event_types", metadata.alias("metadata"))
    )
    per_user = user_ops.with_known_users(per_user, users, ["total_events", "unique_event_types"])
    return (
        with_parts(per_user, F.col("total_events"), items_per_part)
        .join(parts, ["user_uuid", "part"], "left")
        .select("user_uuid", "part", "total_events", "unique_event_types",
                F.coalesce("events", empty_like(parts, "events")).alias("events"), "metadata")
    )
