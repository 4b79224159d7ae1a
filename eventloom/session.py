"""Spark session with the settings the jobs are written for."""

import functools
import math

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Labels come from event_local and do not depend on the zone; pinning it
    # keeps printed instants stable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming session windows: merge rows of one session before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def get_session(app_name="eventloom", **overrides):
    """Session with ``SETTINGS``; keyword arguments add or replace settings
    (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app_name)
    settings = SETTINGS | {k.replace("__", "."): v for k, v in overrides.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Input bytes per shuffle partition.
BYTES_PER_PARTITION = 128 << 20
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def keeps_shuffles(job):
    """Let a job, whose first argument is the session, change the number of shuffle
    partitions for itself only."""
    @functools.wraps(job)
    def run(spark: SparkSession, *args, **options):
        before = spark.conf.get(SHUFFLE_PARTITIONS)
        try:
            return job(spark, *args, **options)
        finally:
            spark.conf.set(SHUFFLE_PARTITIONS, before)

    return run


def fit_shuffles(source: DataFrame) -> int:
    """Raise ``spark.sql.shuffle.partitions`` to suit the size Spark
    estimates for a source table.
    Adaptive execution merges partitions that turn out small, but never splits
    those of an aggregation or window."""
    spark = source.sparkSession
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    count = max(math.ceil(size / BYTES_PER_PARTITION), int(spark.conf.get(SHUFFLE_PARTITIONS)))
    spark.conf.set(SHUFFLE_PARTITIONS, count)
    return count
