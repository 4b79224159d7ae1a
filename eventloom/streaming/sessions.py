"""Session summaries on a stream."""

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import times
from eventloom.schema import SESSION_GAP_MINUTES


def timeless_events_stream(events: DataFrame) -> DataFrame:
    """Events of known users that have no time. They fall into no session window and
    never end a session, so they are a stream of their own beside the summaries."""
    return events.where(F.col("user_uuid").isNotNull() & F.col("event_time").isNull())


def session_summary_stream(events: DataFrame, delay: str = "10 minutes",
                           gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Date, first and last time and size of every session, once it is over.

    A session is known by user, date and start; numbering the sessions of a user
    is left to the batch operator over the finished ones. Events without a time are
    not in it, see ``timeless_events_stream``. With the setting
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``,
    which ``eventloom.session`` turns on, each task merges its rows of a session
    before the shuffle.
    """
    seconds = (
        events.where(F.col("user_uuid").isNotNull())
        .withColumn("_second", F.date_trunc("second", "event_time"))
        .withColumn("session_date", times.date_text(F.col("event_local")))
        .withWatermark("_second", delay)
    )
    return (
        seconds.groupBy("user_uuid", "session_date",
                        F.session_window("_second", f"{round(gap_minutes * 60)} seconds"))
        .agg(F.min("event_local").alias("_first"), F.max("event_local").alias("_last"),
             F.count(F.lit(1)).alias("event_count"))
        .select("user_uuid", "session_date",
                times.clock_seconds(F.col("_first")).alias("start_time"),
                times.clock_seconds(F.col("_last")).alias("end_time"),
                "event_count")
    )
