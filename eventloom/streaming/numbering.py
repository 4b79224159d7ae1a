"""Session numbers on a stream.

A session comes out once it is over, and those of a user in order of time. Each micro-batch
numbers its sessions on from a stored count per user and stores what it counted, all in
folders named after the batch, so that a batch that runs again writes the same again.

Below the folder of a stream::

    finished/N   what batch N brought out, as it came
    sessions/N   the sessions of batch N with their numbers
    counts/N     sessions and events without time so far, of the users in batch N
    totals/N     the same of all users before batch N, where N is a multiple of ``TOTALS_EVERY``
"""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from eventloom.schema import SESSION_GAP_MINUTES
from eventloom.streaming.finite import available_now
from eventloom.streaming.sessions import session_summary_stream, timeless_events_stream

#: Batches after which the counts are put together, so that a batch reads so many at most.
TOTALS_EVERY = 20

SESSIONS = ("user_uuid string, session_id bigint, session_date string, start_time string, end_time string, "
            "event_count bigint")
COUNTS = "user_uuid string, session_count bigint, timeless_count bigint"


def finished_stream(events: DataFrame, delay: str = "10 minutes", gap_minutes=SESSION_GAP_MINUTES) -> DataFrame:
    """Sessions that are over, and events without a time as rows of one event without a date."""
    finished = session_summary_stream(events, delay, gap_minutes)
    timeless = timeless_events_stream(events).select("user_uuid", F.lit(1).cast("bigint").alias("event_count"))
    return finished.unionByName(timeless, allowMissingColumns=True)


def latest(counts: DataFrame) -> DataFrame:
    """Counts only grow, so the largest of a user are the latest."""
    return counts.groupBy("user_uuid").agg(
        F.max("session_count").alias("session_count"), F.max("timeless_count").alias("timeless_count"))


def counts_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Counts of all users before a batch."""
    first = batch_id - batch_id % TOTALS_EVERY
    paths = [f"{folder}/totals/{first}"] if first else []
    paths += [f"{folder}/counts/{number}" for number in range(first, batch_id)]
    reader = spark.read.schema(COUNTS)
    return latest(reader.parquet(*paths)) if paths else spark.createDataFrame([], COUNTS)


def number_batch(finished: DataFrame, batch_id: int, folder: str) -> None:
    """Number the sessions of one micro-batch and store the new counts of their users."""
    spark = finished.sparkSession
    # Written first: the stateful part of the stream then runs once.
    finished.write.mode("overwrite").parquet(f"{folder}/finished/{batch_id}")
    rows = spark.read.schema(finished.schema).parquet(f"{folder}/finished/{batch_id}")
    if batch_id and batch_id % TOTALS_EVERY == 0:
        before = latest(counts_before(spark, folder, batch_id - 1).unionByName(
            spark.read.schema(COUNTS).parquet(f"{folder}/counts/{batch_id - 1}")))
        before.write.mode("overwrite").parquet(f"{folder}/totals/{batch_id}")
    known = counts_before(spark, folder, batch_id).select(
        "user_uuid", F.col("session_count").alias("_sessions"), F.col("timeless_count").alias("_timeless"))
    is_session = F.col("session_date").isNotNull()
    in_order = W.partitionBy("user_uuid").orderBy("session_date", "start_time", "end_time")
    sessions = (
        rows.where(is_session).withColumn("_place", F.row_number().over(in_order))
        .join(known, "user_uuid", "left")
        .select("user_uuid", (F.coalesce("_sessions", F.lit(0)) + F.col("_place")).alias("session_id"),
                "session_date", "start_time", "end_time", "event_count"))
    counts = rows.groupBy("user_uuid").agg(
        F.count_if(is_session).alias("_new"),
        F.coalesce(F.sum(F.when(~is_session, F.col("event_count"))), F.lit(0)).alias("_late"))
    counts = counts.join(known, "user_uuid", "left").select(
        "user_uuid", (F.coalesce("_sessions", F.lit(0)) + F.col("_new")).alias("session_count"),
        (F.coalesce("_timeless", F.lit(0)) + F.col("_late")).alias("timeless_count"))
    sessions.write.mode("overwrite").parquet(f"{folder}/sessions/{batch_id}")
    counts.write.mode("overwrite").parquet(f"{folder}/counts/{batch_id}")


def start_numbering(events: DataFrame, folder: str, delay: str = "10 minutes", gap_minutes=SESSION_GAP_MINUTES):
    """Start the query that numbers the sessions of the input at hand, from its checkpoint on."""
    finished = finished_stream(events, delay, gap_minutes)
    number = lambda batch, batch_id: number_batch(batch, batch_id, folder)
    return available_now(finished, f"{folder}/checkpoint").foreachBatch(number).start()


def numbered_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions that are over, as ``sessions.session_summary`` has them. Events without a time belong
    to the last session of their user, or are one of their own."""
    sessions = spark.read.schema(SESSIONS).parquet(f"{folder}/sessions/*")
    timeless = latest(spark.read.schema(COUNTS).parquet(f"{folder}/counts/*")).where("timeless_count > 0").select(
        "user_uuid", F.greatest("session_count", F.lit(1)).alias("session_id"), "timeless_count")
    joined = sessions.join(timeless, ["user_uuid", "session_id"], "full")
    count = F.coalesce("event_count", F.lit(0)) + F.coalesce("timeless_count", F.lit(0))
    return joined.withColumn("event_count", count).drop("timeless_count")
