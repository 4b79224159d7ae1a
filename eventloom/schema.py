"""Column names, record types and default parameters shared by all modules."""

from pyspark.sql import types as T

# Defaults that decide results.
BURST_MS = 50
SESSION_GAP_MINUTES = 30
NODES_PER_SESSION = 50

# One output row never carries more than this many nested items. A user with
# more items simply continues in the next part (see the README).
ITEMS_PER_PART = 10_000
SESSIONS_PER_PART = 1_000

RAW_COLUMNS = ["user_uuid", "event_name", "category", "event_time"]
CALENDAR_COLUMNS = ["event_date", "event_day", "event_time_only"]
CLEANED_COLUMNS = RAW_COLUMNS + CALENDAR_COLUMNS

# What the operators work on. ``event_time`` is the instant, ``event_local`` the
# wall clock at the source, ``event_pos`` any orderable value that is unique per
# row and follows the order of the source.
EVENT_COLUMNS = RAW_COLUMNS + ["event_local", "event_offset", "event_pos"]

REPETITION_SCHEMA = T.StructType([
    T.StructField("user_uuid", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_date", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("frequency", T.LongType()),
    T.StructField("repetitions_removed", T.LongType()),
    T.StructField("event_day", T.StringType()),
])

USERS_SCHEMA = T.StructType([T.StructField("user_uuid", T.StringType())])

USER_COUNT_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.LongType()),
])

REPLY_SCHEMA = T.StructType([
    T.StructField("interpreted_sessions", T.ArrayType(T.StructType([
        T.StructField("session_name", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("events", T.ArrayType(T.StringType())),
        T.StructField("interpretation", T.StringType()),
    ]))),
    T.StructField("overall_narrative", T.StringType()),
    T.StructField("key_observations", T.ArrayType(T.StringType())),
])
