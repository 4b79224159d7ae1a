"""The jobs: raw log to cleaned table, cleaned table to timeline, and cleaned
table to sessions, journeys and payloads. Each writes below its own folder and
fails if a table is already there."""

from pyspark.sql import SparkSession, functions as F

from eventloom.functions import times
from eventloom.operators import (
    audit, cleaning, flowcharts, increments, journeys, payloads, replies as reply_ops, sessions, users)
from eventloom.schema import (
    BURST_MS, NODES_PER_SESSION, REPETITION_SCHEMA, SESSION_GAP_MINUTES, USERS_SCHEMA)
from eventloom.session import fit_shuffles, keeps_shuffles
from eventloom.sources import readers, sinks, snapshots
from eventloom.sources.shared import drops_intermediate, stored

#: Folders the users are hashed into; None gives each user one, which suits few users only.
USER_BUCKETS = 256


@keeps_shuffles
@drops_intermediate
def clean(spark: SparkSession, source: str, target: str, threshold_ms=BURST_MS,
          fmt: str = "parquet", buckets: int | None = USER_BUCKETS, per_user: bool = True) -> None:
    """Raw CSV to cleaned events, repetition summary, user list and count, and
    one folder per user bucket (per user where ``buckets`` is None)."""
    raw = readers.read_raw_events(spark, source)
    fit_shuffles(raw)
    # The log is parsed once; what follows reads columns of the stored rows.
    raw = stored(raw, "raw")
    order = sinks.name_order() if fmt == "csv" else None
    sinks.write_events(cleaning.cleaned_events(raw, threshold_ms), f"{target}/cleaned_events",
                       order, fmt)
    sinks.write_table(audit.daily_repetition(raw), f"{target}/repetition_summary", fmt)
    write_reports(spark, f"{target}/cleaned_events", target, fmt,
                  buckets, f"{target}/per_user_cleaned_events" if per_user else None)


@keeps_shuffles
@drops_intermediate
def add(spark: SparkSession, source: str, store: str, log: str, threshold_ms=BURST_MS) -> bool:
    """Merge one more raw log into a store, whose events and repetition are then those of all logs in one.
    Only the days it touches are read and written. A log of a name that is in already is left out."""
    raw = readers.read_raw_events(spark, source)
    fit_shuffles(raw)
    return add_events(spark, stored(raw, "raw"), store, log, threshold_ms)


def add_events(spark, events, store, log, threshold_ms=BURST_MS) -> bool:
    return snapshots.add_log(spark, store, log, {
        cells_name(threshold_ms): (
            increments.burst_cells(events, threshold_ms), increments.merged_cells, increments.CELL_KEYS),
        "repetition": (
            increments.repetition_days(events), increments.merged_repetition, increments.REPETITION_KEYS)})


def cells_name(threshold_ms) -> str:
    return f"cells_{cleaning.threshold_micros(threshold_ms)}us"


def read_store(spark: SparkSession, store: str, threshold_ms=BURST_MS, number: int | None = None):
    """(cleaned events, repetition of all days) of a store, as of its last manifest or an earlier one. The
    threshold is that with which its logs were added."""
    cells = snapshots.read_snapshot(spark, store, cells_name(threshold_ms), number)
    days = snapshots.read_snapshot(spark, store, "repetition", number)
    return times.calendar(increments.kept_of_cells(cells, threshold_ms)), days.drop("day")


@keeps_shuffles
@drops_intermediate
def timeline(spark: SparkSession, source: str, target: str, threshold_ms=None,
             fmt: str = "parquet", buckets: int | None = USER_BUCKETS, per_user: bool = True) -> None:
    """Cleaned events to a table in time order, with the same reports over it."""
    cleaned = read_events(spark, f"{source}/cleaned_events", fmt, "clean")
    fit_shuffles(cleaned)
    kept = cleaned if threshold_ms is None else cleaning.remove_bursts(cleaned, threshold_ms)
    sinks.write_events(kept, f"{target}/cleaned_events_chronological", sinks.time_order(), fmt)
    sinks.write_table(audit.daily_repetition(cleaned), f"{target}/repetition_summary", fmt)
    write_reports(spark, f"{target}/cleaned_events_chronological", target, fmt,
                  buckets, f"{target}/per_user_timelines" if per_user else None)


def write_reports(spark, events_path, target, fmt, buckets, per_user_path):
    """What follows from an event table already written."""
    events = read_events(spark, events_path, fmt, "same")
    sinks.write_table(users.unique_users(events), f"{target}/unique_users_list", fmt)
    sinks.write_table(users.unique_users_count(events), f"{target}/unique_users_count", fmt)
    if per_user_path is not None:
        sinks.write_per_user(events, per_user_path, fmt, buckets)


def read_events(spark, path, fmt, made_by):
    if fmt == "csv":
        try:
            return readers.read_cleaned_csv(spark, path)
        except readers.MissingInput as error:
            raise readers.MissingInput(f"{path} not found; run the {made_by} job first") from error
    return readers.read_table(spark, path, made_by)


@keeps_shuffles
@drops_intermediate
def analyse(spark: SparkSession, source: str, target: str, instruction: str,
            category: str = "application", gap_minutes=SESSION_GAP_MINUTES,
            max_nodes=NODES_PER_SESSION) -> None:
    """Tables of the clean job to sessions, journeys, charts, metrics and
    prompts over the events of one category. Numbering the events is done once
    and stored; the rest reads the stored table."""
    cleaned = readers.read_table(spark, f"{source}/cleaned_events", "clean")
    repetition = readers.read_table(spark, f"{source}/repetition_summary", "clean",
                                    REPETITION_SCHEMA)
    known = readers.read_table(spark, f"{source}/unique_users_list", "clean", USERS_SCHEMA)
    fit_shuffles(cleaned)
    events = users.select_category(cleaned, category)
    sinks.write_table(sessions.number_events(events, gap_minutes, max_nodes),
                      f"{target}/numbered_events")
    numbered = readers.read_table(spark, f"{target}/numbered_events", "same")
    charts = flowcharts.with_empty_charts(flowcharts.flowcharts(numbered), known)
    for name, table in {
        "session_summary": sessions.session_summary(events, gap_minutes),
        "session_cards": sessions.session_cards(numbered),
        "journey_paths": journeys.journey_path(numbered, users=known),
        "journey_nodes": journeys.journey_nodes(numbered),
        "journey_edges": journeys.journey_edges(numbered),
        "journey_records": journeys.journey_record(numbered, events, known),
        "transitions": journeys.transitions(numbered),
        "flowcharts": charts,
        "user_metrics": users.user_metrics(events, known),
        "event_breakdown": users.event_breakdown(events),
    }.items():
        sinks.write_table(table, f"{target}/{name}")
    metrics = readers.read_table(spark, f"{target}/user_metrics", "same")
    payload = payloads.ai_payload(numbered, metrics, repetition)
    sinks.write_table(payloads.prompt_table(payload, instruction), f"{target}/prompts")


@keeps_shuffles
@drops_intermediate
def replies(spark: SparkSession, source: str, events: str, target: str) -> None:
    """Stored replies (user, part, content) to their sessions, notes and audit against the cleaned
    events. ``parsed_replies`` has the verdict on each, and the whole value of a structured one as
    JSON text."""
    given = readers.read_table(spark, source, "model")
    cleaned = readers.read_table(spark, f"{events}/cleaned_events", "clean")
    fit_shuffles(cleaned)
    parsed = stored(reply_ops.parse_replies(given.select(*reply_ops.KEYS, "content")), "replies")
    for name, table in {
        "parsed_replies": parsed.withColumn("reply", F.to_json("reply")).drop("parsed"),
        "reply_sessions": reply_ops.reply_sessions(parsed),
        "reply_notes": reply_ops.reply_notes(parsed),
        "reply_audit": reply_ops.reply_audit(parsed, cleaned),
    }.items():
        sinks.write_table(table, f"{target}/{name}")


def register_views(spark: SparkSession, source: str) -> None:
    """Tables of the clean job as temporary views for SQL."""
    for name in ("cleaned_events", "repetition_summary", "unique_users_list"):
        readers.read_table(spark, f"{source}/{name}", "clean").createOrReplaceTempView(name)

