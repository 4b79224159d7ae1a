"""Flowchart text of a journey: one subgraph per session, one node per event."""

from pyspark.sql import DataFrame, functions as F

from eventloom.operators.journeys import journey_nodes
from eventloom.operators.parts import in_sequence, part_of
from eventloom.operators.sessions import number_events, session_label
from eventloom.operators.users import known_users, select_category
from eventloom.schema import NODES_PER_SESSION, SESSION_GAP_MINUTES, SESSIONS_PER_PART

# The lines every chart shares.
HEADER = "flowchart TD"
EMPTY_CHART = "flowchart LR\n    A[No Events Found]"
STYLE = "    classDef default fill:#4a5568,stroke:#2d3748,color:#fff"


def session_block():
    """Lines of one session; with more than one session they form a subgraph."""
    many = F.col("session_count") > 1
    indent = F.when(many, F.lit("        ")).otherwise(F.lit("    "))
    number = F.col("node_sequence")
    node = F.concat(indent, F.col("node_id"), F.lit('["'), F.col("label"), F.lit('"]'))
    edge = F.concat(F.lit("\n"), indent, F.lit("N"), (number - 1).cast("string"),
                    F.lit(" --> "), F.col("node_id"))
    return F.when(F.col("session_sequence") > 1, F.concat(node, edge)).otherwise(node)


def flowchart_text(events: DataFrame, users: DataFrame | None = None,
                   max_nodes=NODES_PER_SESSION, gap_minutes=SESSION_GAP_MINUTES,
                   category: str | None = None) -> DataFrame:
    """Chart per user from plain events, of one category if given; with users,
    also for those who have no events."""
    if category is not None:
        events = select_category(events, category)
    charts = flowcharts(number_events(events, gap_minutes, max_nodes))
    return charts if users is None else with_empty_charts(charts, users)


def with_empty_charts(charts: DataFrame, users: DataFrame) -> DataFrame:
    """Charts of the users given; the placeholder chart for those who have none."""
    return known_users(users).join(charts, "user_uuid", "left").select(
        "user_uuid", F.coalesce("part", F.lit(1).cast("bigint")).alias("part"),
        F.coalesce("flowchart", F.lit(EMPTY_CHART)).alias("flowchart"))


def flowcharts(numbered: DataFrame, sessions_per_part=SESSIONS_PER_PART) -> DataFrame:
    """Chart per user from numbered events. Charts of more than
    ``sessions_per_part`` sessions come in parts; joined by line breaks they are
    the whole chart."""
    blocks = (
        journey_nodes(numbered)
        .withColumn("_lines", session_block())
        .groupBy("user_uuid", "session_id", "session_count")
        .agg(F.min("event_local").alias("_first"), F.max("event_local").alias("_last"),
             in_sequence(F.col("session_sequence"), F.col("_lines")).alias("_lines"))
    )
    lines = F.array_join("_lines", "\n")
    number = F.col("session_id")
    opening = F.concat(
        F.lit("    subgraph S"), (number - 1).cast("string"), F.lit('["'),
        session_label(number, F.col("_first"), F.col("_last")), F.lit('"]\n'))
    text = F.when(F.col("session_count") > 1,
                  F.concat(opening, lines, F.lit("\n    end"))).otherwise(lines)
    last_part = part_of(F.col("session_count"), sessions_per_part)
    return (
        blocks.groupBy("user_uuid", part_of(number, sessions_per_part).alias("part"),
                       last_part.alias("parts"))
        .agg(F.array_join(in_sequence(number, text), "\n").alias("_text"))
        .select(
            "user_uuid", "part",
            F.concat(
                F.when(F.col("part") == 1, F.lit(HEADER + "\n")).otherwise(F.lit("")),
                "_text",
                F.when(F.col("part") == F.col("parts"), F.lit("\n\n" + STYLE))
                .otherwise(F.lit("")),
            ).alias("flowchart"))
    )
