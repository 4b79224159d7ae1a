"""Reading event logs and the tables the jobs write."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from eventloom.functions import times
from eventloom.schema import CALENDAR_COLUMNS, RAW_COLUMNS
from eventloom.sources import quoted_lines

# Fixed value: the time format of raw logs; one to six digits of fraction are
# required. The offset may be +0530, +05:30 or Z.
RAW_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS [xxx][xx][X]"
OFFSET_PATTERN = r"(Z|[+-]\d\d:?\d\d)$"


class MissingInput(FileNotFoundError):
    """A table that another job should have written is not there."""


def marked_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Event CSV with all columns as text, in any column order, plus the source
    position and ``malformed_row``: the line as it came where it has more fields
    than the header, or a quote that is never closed and swallows later fields.
    Lines with fewer fields are legal, the rest is null. Columns beyond the known
    ones are kept. Files whose headers differ fail the job.

    Files with line breaks inside quotes need ``multi_line``, see ``quoted_lines``: files are still
    split between tasks, but all lines go through a shuffle. A record of more than
    ``quoted_lines.MAX_LINES`` lines counts as a quote that is never closed, and each of its
    lines as malformed.
    """
    reader = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("enforceSchema", False).option("columnPruning", False)
        .option("columnNameOfCorruptRecord", "malformed_row")
    )
    try:
        names = reader.csv(path).columns
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingInput(f"{path} not found") from error
    if multi_line:
        events = quoted_records(spark, path, names)
    else:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, "malformed_row"]])
        # Row ids grow within a file split; path and offset put the splits in order.
        position = F.struct("_metadata.file_path", "_metadata.file_block_start",
                            F.monotonically_increasing_id().alias("row"))
        events = reader.schema(schema).csv(path).withColumns({
            "malformed_row": F.when(is_malformed("malformed_row", names), F.col("malformed_row")),
            "event_pos": position})
    missing = [name for name in RAW_COLUMNS if name not in events.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return events


def is_malformed(record: str, names: list[str]):
    """More fields than the header, or a quote left open."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return (F.regexp_count(bare, F.lit(",")) >= len(names)) | bare.contains('"')


def quoted_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The columns of ``marked_csv`` from records that may hold line breaks."""
    rows = quoted_lines.records(spark, path).where((F.btrim("_record") != "") | F.col("_runaway"))
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    fields = F.from_csv("_record", schema, {"escape": '"'})
    parsed = rows.withColumn("_fields", F.when(~F.col("_runaway"), fields))
    given = F.array(*[F.col(f"_fields.`{name}`") for name in names])
    differs = (F.col("_at") == 0) & ~given.eqNullSafe(F.array(*map(F.lit, names)))
    message = F.concat(F.lit("another header: "), F.col("_record"))
    kept = F.when(differs, F.raise_error(message).cast("boolean")).otherwise(F.col("_at") > 0)
    odd = F.col("_runaway") | is_malformed("_record", names)
    position = F.struct(F.col(quoted_lines.FILE).alias("file_path"),
                        F.col(quoted_lines.SPLIT).alias("file_block_start"), F.col("_row").alias("row"))
    return parsed.where(kept).select(
        *[F.col(f"_fields.`{name}`").alias(name) for name in names],
        F.when(odd, F.col("_record")).alias("malformed_row"), position.alias("event_pos"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Event CSV as ``marked_csv`` reads it; a malformed line fails the job."""
    events = marked_csv(spark, path, multi_line)
    message = F.concat(F.lit("malformed line: "), F.col("malformed_row"))
    bad = F.col("malformed_row").isNotNull()
    return events.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)).drop(
        "malformed_row")


def with_times(events: DataFrame, instant) -> DataFrame:
    """Replace the text in ``event_time`` by the instant; add wall clock and
    offset as the text has them."""
    text = F.trim("event_time")
    offset = F.regexp_extract(text, OFFSET_PATTERN, 1)
    colon = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.right(offset, F.lit(2)))
    local = F.trim(F.regexp_replace(text, OFFSET_PATTERN, "")).try_cast("timestamp_ntz")
    return events.withColumns({
        "event_time": instant,
        "event_local": F.when(instant.isNotNull(), local),
        "event_offset": F.when(instant.isNotNull(),
                               F.when(offset.isin("Z", ""), F.lit("+00:00")).otherwise(colon)),
    })


def unreadable(instant):
    return instant.isNull() & F.col("event_time").isNotNull()


def or_fail(instant):
    message = F.concat(F.lit("unreadable event_time: "), F.col("event_time"))
    return F.when(unreadable(instant), F.raise_error(message).cast("timestamp")).otherwise(instant)


def raw_instant():
    return F.try_to_timestamp(F.trim("event_time"), F.lit(RAW_TIME_FORMAT))


def parse_raw(events: DataFrame) -> DataFrame:
    """Raw rows with parsed time; a value in another format fails the job."""
    return with_times(events, or_fail(raw_instant()))


def parse_raw_lenient(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows with parsed time, and the rejected rows as they came."""
    instant = raw_instant()
    return (with_times(events.where(~unreadable(instant)), instant),
            events.where(unreadable(instant)))


def parse_iso(events: DataFrame) -> DataFrame:
    """Rows whose time is ISO 8601, with or without fraction; without an offset
    it counts as offset zero."""
    text = F.trim("event_time")
    zoned = F.when(text.rlike(OFFSET_PATTERN), text).otherwise(F.concat(text, F.lit("Z")))
    return with_times(events, or_fail(zoned.try_cast("timestamp")))


def read_raw_events(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return parse_raw(read_csv(spark, path, multi_line))


def read_raw_lenient(spark: SparkSession, path: str,
                     multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Readable rows with parsed time, and the rejected rows: malformed lines, with
    ``malformed_row`` set, and those whose time is unreadable, as they came."""
    events = marked_csv(spark, path, multi_line)
    whole = F.col("malformed_row").isNull()
    good, unread = parse_raw_lenient(events.where(whole))
    return good.drop("malformed_row"), unread.unionByName(events.where(~whole))


def read_cleaned_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A cleaned or chronological table stored as CSV; the derived columns are
    computed again from the time."""
    return times.calendar(parse_iso(read_csv(spark, path, multi_line).drop(*CALENDAR_COLUMNS)))


def read_table(spark: SparkSession, path: str, made_by: str, schema=None) -> DataFrame:
    """Parquet table of an earlier job; names that job when there is none."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingInput(f"{path} not found; run the {made_by} job first") from error
