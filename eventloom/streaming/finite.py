"""Streams that come to an end.

A watermark trails behind the last event, so that what is still open when the input ends never
comes out. An event far in the future, read from a folder of its own, moves the watermark past
everything. It opens a cell and a session that no later event closes, so that it comes out of
no operator itself.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: later than any event.
END_OF_TIME = "9999-12-01 00:00:00"
END_USER = "(end of stream)"


def end_rows(events: DataFrame) -> DataFrame:
    """The closing event in the columns of ``events``, as a batch table."""
    spark = events.sparkSession
    given = {"user_uuid": F.lit(END_USER), "event_name": F.lit(""),
             "event_time": F.lit(END_OF_TIME).cast("timestamp"),
             "event_local": F.lit(END_OF_TIME).cast("timestamp_ntz")}
    return spark.range(1).select(*[
        given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in events.schema])


def with_end(events: DataFrame, folder: str) -> DataFrame:
    """The stream of events, and whatever ``mark_end`` puts into ``folder``."""
    end_rows(events).where("false").write.mode("ignore").parquet(folder)
    ends = events.sparkSession.readStream.schema(events.schema).parquet(folder)
    return events.unionByName(ends)


def mark_end(events: DataFrame, folder: str) -> None:
    end_rows(events).write.mode("append").parquet(folder)


def run_available(start: Callable[[], StreamingQuery]) -> None:
    """Run a query started with ``availableNow`` until the input at hand is used up."""
    query = start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_to_end(events: DataFrame, folder: str, start: Callable[[], StreamingQuery]) -> None:
    """Use up the input, mark its end and run again from the checkpoint, so that all comes out.
    ``events`` is the stream before ``with_end``."""
    run_available(start)
    mark_end(events, folder)
    run_available(start)


def available_now(frame: DataFrame, checkpoint: str):
    """Writer of a stream in append mode for the input at hand."""
    return frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)


def file_events(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream over the Parquet files at a path, a folder or a single file. With ``max_files`` each
    micro-batch takes that many, oldest first; else one takes all there are."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    # As a pattern, since a plain path may only be a folder.
    return reader.parquet(f"{folder}/{{{name}}}")
