"""Selections, metrics and breakdowns per user and over all users."""

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import times


def select_users(df: DataFrame, users) -> DataFrame:
    """Rows of one user id, a short list of ids, or a DataFrame of ids."""
    if isinstance(users, DataFrame):
        return df.join(users.select("user_uuid").distinct(), "user_uuid", "left_semi")
    ids = [users] if isinstance(users, str) else list(users)
    return df.where(F.col("user_uuid").isin(ids))


def select_category(events: DataFrame, category: str = "application") -> DataFrame:
    """Rows of one category, in any letter case; a null category never matches."""
    return events.where(F.lower("category") == category.lower())


def select_event(df: DataFrame, event_name: str | None = None) -> DataFrame:
    """Rows of one event name, on events or on the repetition summary; all rows
    when no name is given."""
    return df if event_name is None else df.where(F.col("event_name") == event_name)


def user_events_view(events: DataFrame, users=None, category: str | None = None,
                     event_name: str | None = None) -> DataFrame:
    """Display columns of the selected events, plus user and order columns."""
    if users is not None:
        events = select_users(events, users)
    if category is not None:
        events = select_category(events, category)
    return times.calendar(select_event(events, event_name)).select(
        "user_uuid", "event_date", "event_day", "event_time_only", "event_name", "category",
        "event_local", "event_pos")


def in_time_order(view: DataFrame) -> DataFrame:
    """Rows of a view by wall clock, for reading by people."""
    return view.orderBy("user_uuid", F.col("event_local").asc_nulls_last(),
                        F.col("event_name").asc_nulls_last(), "event_pos")


def known_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("user_uuid").isNotNull()).select("user_uuid").distinct()


def with_known_users(per_user: DataFrame, users: DataFrame | None, counts: list[str]) -> DataFrame:
    """Rows per user for all users given, with counts of 0 for those without a row; the rows
    as they are when no users are given."""
    if users is None:
        return per_user
    return known_users(users).join(per_user, "user_uuid", "left").fillna(0, counts)


def unique_users(events: DataFrame) -> DataFrame:
    return events.select("user_uuid").distinct()


def user_list(events: DataFrame) -> DataFrame:
    """Users in order, for choosing one."""
    return unique_users(events).orderBy(F.col("user_uuid").asc_nulls_last())


def unique_users_count(events: DataFrame) -> DataFrame:
    """One-row report; rows without a user count as one user."""
    return unique_users(events).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("total_unique_users").alias("metric"), "value")


def global_metrics(events: DataFrame) -> DataFrame:
    """Users (without the null user) and events in one row."""
    return events.agg(F.countDistinct("user_uuid").alias("total_users"),
                      F.count(F.lit(1)).alias("total_events"))


def user_metrics(events: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Event count, distinct names, first and last event and span in days; with users,
    also for those who have no events, with zeros."""
    date = F.col("event_local").cast("date")
    metrics = (
        events.where(F.col("user_uuid").isNotNull())
        .groupBy("user_uuid")
        .agg(F.count(F.lit(1)).alias("total_events"),
             F.countDistinct("event_name").alias("unique_event_types"),
             F.min("event_local").alias("_first"), F.max("event_local").alias("_last"),
             (F.datediff(F.max(date), F.min(date)) + 1).cast("bigint").alias("span_days"))
        .select("user_uuid", "total_events", "unique_event_types",
                times.date_time_text(F.col("_first")).alias("first_event"),
                times.date_time_text(F.col("_last")).alias("last_event"), "span_days")
    )
    return with_known_users(metrics, users, ["total_events", "unique_event_types", "span_days"])


def user_event_types(events: DataFrame) -> DataFrame:
    """Distinct event names per user, numbered in alphabetical order."""
    by_name = W.partitionBy("user_uuid").orderBy("event_name")
    return (
        events.where(F.col("user_uuid").isNotNull() & F.col("event_name").isNotNull())
        .select("user_uuid", "event_name").distinct()
        .withColumn("position", F.row_number().over(by_name).cast("bigint"))
    )


def event_breakdown(events: DataFrame) -> DataFrame:
    """Events per user and name; rank 1 is the most frequent name."""
    by_count = W.partitionBy("user_uuid").orderBy(F.desc("event_count"), "event_name")
    return (
        events.where(F.col("user_uuid").isNotNull() & F.col("event_name").isNotNull())
        .groupBy("user_uuid", "event_name").agg(F.count(F.lit(1)).alias("event_count"))
        .withColumn("rank", F.row_number().over(by_count).cast("bigint"))
    )


def category_breakdown(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("user_uuid").isNotNull() & F.col("category").isNotNull())
        .groupBy("user_uuid", "category").agg(F.count(F.lit(1)).alias("event_count"))
    )


def most_repeated_name():
    """Aggregate over repetition rows: the name with the highest frequency on a
    single day; ties go to the first name, then the first date."""
    return F.min_by("event_name", F.struct(-F.col("frequency"), "event_name", "event_date"))


def most_repeated(repetition: DataFrame) -> DataFrame:
    return repetition.groupBy("user_uuid").agg(
        most_repeated_name().alias("most_repeated_event"), F.max("frequency").alias("frequency"))
