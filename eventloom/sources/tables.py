"""Event tables derived from the ``events`` Parquet table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.functions import times
from eventloom.streaming.finite import file_events

# Declared, so that no file is opened to find it out. Columns not used are left out.
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"

SYSTEM_EVENTS = ["error", "signup"]

# Shift in microseconds of the k-th copy, made where event_id is
# divisible by the second number. The shifts lie on both sides of 50 ms gaps.
COPIES = [(0, 1, 0), (1, 3, 20_000), (2, 4, 70_000), (3, 5, 120_001)]


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in the columns the operators expect, at offset zero."""
    return adapted(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def stream_events(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream over the files of the table."""
    return adapted(file_events(spark, f"{sf_dir}/events.parquet", EVENTS_SCHEMA, max_files))


def adapted(table: DataFrame) -> DataFrame:
    system = F.when(F.col("event_type").isin(SYSTEM_EVENTS), F.lit("system")).otherwise(
        F.lit("Application"))
    return shaped(table.select(
        F.col("user_id").cast("string").alias("user_uuid"),
        F.col("event_type").alias("event_name"),
        system.alias("category"),
        F.col("ts").alias("event_local"),
        F.col("event_id").alias("event_pos"),
    ))


def shaped(events: DataFrame) -> DataFrame:
    return events.select(
        "user_uuid", "event_name", "category",
        F.timestamp_micros(times.local_micros(F.col("event_local"))).alias("event_time"),
        "event_local", F.lit("+00:00").alias("event_offset"), "event_pos")


def with_copies(events: DataFrame) -> DataFrame:
    """Every event plus shifted copies of some, so that there are bursts."""
    made = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"),
                              F.expr(f"interval {us} microseconds").alias("shift")) for k, n, us in COPIES])
    # All copies of a row and then a filter: both are compiled, a function over the array is not.
    copies = events.withColumn("_copy", F.explode(made)).where(F.pmod("event_pos", F.col("_copy.n")) == 0)
    return shaped(copies.withColumns({
        "event_local": F.col("event_local") + F.col("_copy.shift"),
        "event_pos": F.col("event_pos") * 10 + F.col("_copy.k"),
    }))
