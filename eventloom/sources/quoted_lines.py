"""CSV records with line breaks inside quotes, read from many splits of a file.

A line belongs to the record before it when an odd number of quotes stands before it in the file.
Quotes are counted line by line within a split of the file, and split by split within the
file, so that no task reads a whole file. Doubled quotes inside quotes count twice and change nothing.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Lines a record may have. A quote that is never closed swallows what follows; a longer record
#: is taken for such a fault, so that no task holds more lines of one record.
MAX_LINES = 1000

FILE, SPLIT = "_file", "_split"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are, with file, split and a number that grows within the split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("_line"))


def running(column, order: W, fill=0) -> Column:
    """Sum over the rows before."""
    return F.coalesce(F.sum(column).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(fill))


def placed_lines(lines: DataFrame) -> DataFrame:
    """Add ``_at``, the number of the line in its file from 0, and ``_start``, that of the first line of
    its record."""
    quotes = F.length("_line") - F.length(F.replace("_line", F.lit('"'), F.lit("")))
    in_split = W.partitionBy(FILE, SPLIT).orderBy("_row")
    local = lines.withColumn("_odd", quotes % 2).withColumns({
        "_here": (F.row_number().over(in_split) - 1).cast("bigint"), "_before": running("_odd", in_split) % 2})

    def last_start(parity):
        """Last line of a split that starts a record, if so many quotes stand before the split."""
        return F.max(F.when(F.col("_before") == parity, F.col("_here")))

    splits = local.groupBy(FILE, SPLIT).agg(
        F.count(F.lit(1)).alias("_lines"), F.sum("_odd").alias("_quotes"),
        last_start(0).alias("_last0"), last_start(1).alias("_last1"))
    in_file = W.partitionBy(FILE).orderBy(SPLIT)
    carried = splits.withColumns({
        "_first": running("_lines", in_file), "_parity": running("_quotes", in_file) % 2})
    last = F.when(F.col("_parity") == 0, F.col("_last0")).otherwise(F.col("_last1")) + F.col("_first")
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    carried = carried.withColumn("_last", last).select(
        F.col(FILE).alias("_of_file"), F.col(SPLIT).alias("_of_split"), "_first", "_parity",
        F.max("_last").over(earlier).alias("_open"))
    same = (F.col(FILE) == F.col("_of_file")) & (F.col(SPLIT) == F.col("_of_split"))
    at = F.col("_first") + F.col("_here")
    starts = F.when((F.col("_before") + F.col("_parity")) % 2 == 0, at)
    so_far = in_split.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        local.join(carried, same).withColumns({"_at": at, "_starts": starts})
        .withColumn("_start", F.coalesce(F.max("_starts").over(so_far), F.col("_open")))
        .select(FILE, SPLIT, "_row", "_line", "_odd", "_at", "_start"))


def records(spark: SparkSession, path: str, max_lines=MAX_LINES) -> DataFrame:
    """(_file, _split, _row, _at, _record, _runaway): a row per record, with the place of its first line.
    The lines of a record that is too long are rows of their own, marked as runaway."""
    placed = placed_lines(physical_lines(spark, path))
    depth = F.col("_at") - F.col("_start")
    # Nearly all records are one line and go straight on.
    single = (depth == 0) & (F.col("_odd") == 0)
    alone = placed.where(single).select(
        FILE, SPLIT, "_row", "_at", F.col("_line").alias("_record"), F.lit(False).alias("_runaway"))
    several = placed.where(~single)
    grouped = several.where(depth <= max_lines).groupBy(FILE, "_start").agg(F.array_sort(F.collect_list(
        F.struct("_at", SPLIT, "_row", "_line"))).alias("_parts"))
    joined = F.array_join(F.transform("_parts", lambda part: part["_line"]), "\n")
    whole = grouped.where(F.size("_parts") <= max_lines).select(
        FILE, F.col("_parts")[0][SPLIT].alias(SPLIT), F.col("_parts")[0]["_row"].alias("_row"),
        F.col("_start").alias("_at"), joined.alias("_record"), F.lit(False).alias("_runaway"))
    too_long = grouped.where(F.size("_parts") > max_lines).select(FILE, F.explode("_parts").alias("_part")).select(
        FILE, f"_part.{SPLIT}", "_part._row", "_part._at", F.col("_part._line").alias("_record"),
        F.lit(True).alias("_runaway"))
    beyond = several.where(depth > max_lines).select(
        FILE, SPLIT, "_row", "_at", F.col("_line").alias("_record"), F.lit(True).alias("_runaway"))
    return alone.unionByName(whole).unionByName(too_long).unionByName(beyond)
