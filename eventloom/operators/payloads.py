"""Per-user JSON payloads and prompts for a language model run elsewhere."""

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import times
from eventloom.operators import users as user_ops
from eventloom.operators.audit import daily_repetition
from eventloom.operators.journeys import empty_like
from eventloom.operators.parts import in_sequence, part_of, with_parts
from eventloom.operators.sessions import number_events
from eventloom.schema import ITEMS_PER_PART
from eventloom.sources.shared import stored

# Fixed value: stands between the instruction and the payload.
DATA_HEADING = "\n\nUSER EVENT DATA:\n"


def ordered_events(numbered: DataFrame, items_per_part) -> DataFrame:
    item = F.struct(
        F.col("event_date"),
        times.strip_quotes(F.col("event_time_only")).alias("event_time"),
        "event_name", "category", "event_day",
    )
    place = F.col("sequence")
    return (
        times.calendar(numbered)
        .groupBy("user_uuid", part_of(place, items_per_part).alias("part"))
        .agg(in_sequence(place, item).alias("events_ordered"))
    )


def repeated_events(repetition: DataFrame, items_per_part) -> DataFrame:
    """Repetition rows of a user as arrays, by name and date. A user has one row
    per name and day at most, so numbering them is a small window."""
    place = F.row_number().over(
        W.partitionBy("user_uuid").orderBy("event_name", "event_date"))
    item = F.struct("event_name", "frequency", "repetitions_removed")
    return (
        repetition.withColumn("_place", place)
        .groupBy("user_uuid", part_of(F.col("_place"), items_per_part).alias("part"))
        .agg(in_sequence(F.col("_place"), item).alias("repeated_events"))
    )


def ai_payload(numbered: DataFrame, metrics: DataFrame, repetition: DataFrame,
               items_per_part=ITEMS_PER_PART) -> DataFrame:
    """Ordered events and repetition summary of every user in ``metrics``, the output of
    ``users.user_metrics`` with all users wanted, or of ``category_totals``. ``numbered`` is
    the output of ``sessions.number_events`` over the same events.

    Long lists continue in further parts, each a payload with the totals of the
    whole user. A user without events gets the empty payload, whatever the
    repetition summary holds.
    """
    listed = ordered_events(numbered, items_per_part)
    repeated = repeated_events(repetition, items_per_part)
    repeats = repetition.groupBy("user_uuid").agg(
        user_ops.most_repeated_name().alias("most_repeated_event"),
        F.count(F.lit(1)).alias("_repeated"))
    per_user = metrics.select("user_uuid", "total_events", "unique_event_types").join(
        repeats, "user_uuid", "left")
    has_events = F.col("total_events") > 0
    items = F.when(has_events, F.greatest("total_events", "_repeated")).otherwise(0)
    most_repeated = F.when(has_events, F.col("most_repeated_event"))
    no_repeats = empty_like(repeated, "repeated_events")
    return (
        with_parts(per_user, items, items_per_part)
        .join(listed, ["user_uuid", "part"], "left")
        .join(repeated, ["user_uuid", "part"], "left")
        .select(
            "user_uuid", "part",
            F.struct(
                F.col("user_uuid").alias("user_id"),
                F.coalesce("events_ordered", empty_like(listed, "events_ordered"))
                .alias("events_ordered"),
                F.struct(
                    "total_events", "unique_event_types",
                    most_repeated.alias("most_repeated_event"),
                    F.when(has_events, F.coalesce("repeated_events", no_repeats))
                    .otherwise(no_repeats).alias("repeated_events"),
                ).alias("repetition_summary"),
            ).alias("payload"))
    )


def category_totals(events: DataFrame, category: str) -> DataFrame:
    """Events and distinct names of one category for all known users, in one pass over all events."""
    name = F.when(F.lower("category") == category.lower(), F.col("event_name"))
    inside = F.coalesce(F.lower("category") == category.lower(), F.lit(False))
    return events.where(F.col("user_uuid").isNotNull()).groupBy("user_uuid").agg(
        F.sum(inside.cast("bigint")).alias("total_events"), F.countDistinct(name).alias("unique_event_types"))


def user_payloads(raw: DataFrame, cleaned: DataFrame, category="application",
                  repetition_scope="all", items_per_part=ITEMS_PER_PART) -> DataFrame:
    """Payloads from the event tables themselves: events of one category from
    the cleaned table, repetition counted on the raw one. With scope ``all`` the
    repetition rows include every category."""
    if repetition_scope not in ("all", "category"):
        raise ValueError("repetition_scope is 'all' or 'category'")
    counted = raw if repetition_scope == "all" else user_ops.select_category(raw, category)
    # Read twice, as arrays and as totals, so it is stored.
    repetition = stored(daily_repetition(counted), "repetition")
    return ai_payload(number_events(user_ops.select_category(cleaned, category)),
                      category_totals(cleaned, category), repetition, items_per_part)


def payload_json(payloads: DataFrame) -> DataFrame:
    return payloads.select("user_uuid", "part", F.to_json(
        "payload", {"ignoreNullFields": "false"}).alias("payload_json"))


def prompt_table(payloads: DataFrame, instruction: str) -> DataFrame:
    """One prompt per payload: instruction, heading, payload as JSON."""
    return payload_json(payloads).select("user_uuid", "part", F.concat(
        F.lit(instruction), F.lit(DATA_HEADING), "payload_json").alias("prompt"))
