"""Writing tables. Nothing is ever overwritten."""

from pyspark.sql import DataFrame, functions as F

from eventloom.functions import texts
from eventloom.operators.ordering import total_order
from eventloom.schema import CLEANED_COLUMNS

HELPERS = ["event_local", "event_offset", "event_pos"]


def export_columns(events: DataFrame) -> DataFrame:
    """The seven text columns of a cleaned table, any extra columns behind; the
    time is ISO 8601 with the offset of the source."""
    iso = F.concat(F.col("event_local").cast("string"), F.col("event_offset"))
    extra = [c for c in events.columns if c not in CLEANED_COLUMNS + HELPERS]
    return events.withColumn("event_time", iso).select(*CLEANED_COLUMNS, *extra)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def ordered(df: DataFrame, *order, partitions: int | None = None) -> DataFrame:
    """Total order over all output files. Range partitions are cut by the full
    order, so one user may fill many of them."""
    ranges = order if partitions is None else (partitions, *order)
    return df.repartitionByRange(*ranges).sortWithinPartitions(*order)


def time_order():
    return total_order("event_time")


def name_order():
    return (F.col("user_uuid").asc_nulls_last(), F.col("event_name").asc_nulls_last(),
            F.col("event_time").asc_nulls_last(), F.col("event_pos").asc_nulls_last())


def write_events(events: DataFrame, path: str, order=None, fmt: str = "parquet",
                 partitions: int | None = None) -> None:
    """Write an event table, sorted when an order is given. Parquet keeps all
    columns, CSV gets those of ``export_columns``."""
    if order is not None:
        events = ordered(events, *order, partitions=partitions)
    write_table(export_columns(events) if fmt == "csv" else events, path, fmt)


def write_per_user(events: DataFrame, path: str, fmt: str = "csv", buckets: int | None = None,
                   partitions: int | None = None, rows_per_file: int = 1_000_000) -> None:
    """One directory per user, without the rows that have no user; files of a
    user are in time order. With ``buckets``, users are hashed into that many
    directories instead, which suits many users better.
    """
    known = events.where(F.col("user_uuid").isNotNull())
    # Directory names are escaped, so ids that differ only in a slash and an
    # underscore stay apart.
    name, layout = "user_key", F.col("user_uuid")
    if buckets is not None:
        name, layout = "user_bucket", F.pmod(F.hash("user_uuid"), F.lit(buckets))
    rows = ordered(known.withColumn(name, layout), F.col(name), *time_order(),
                   partitions=partitions)
    shown = export_columns(rows) if fmt == "csv" else rows
    writer = (shown.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
              .partitionBy(name))
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def with_user_key(df: DataFrame) -> DataFrame:
    return df.withColumn("user_key", texts.user_key(F.col("user_uuid")))
