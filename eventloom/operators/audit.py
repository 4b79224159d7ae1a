"""Reports on repeated events."""

from pyspark.sql import DataFrame, Window as W, functions as F

from eventloom.functions import times
from eventloom.operators.cleaning import KEYS, threshold_micros
from eventloom.schema import BURST_MS, REPETITION_SCHEMA

# Cells per scan block; bounds the rows of one window group in burst_audit.
CELLS_PER_BLOCK = 65_536


def daily_repetition(events: DataFrame, repeated_only: bool = True) -> DataFrame:
    """How often each user sent each event on each day, with first and last time.

    ``repetitions_removed`` is ``frequency - 1`` over all rows given, whether or
    not burst removal would drop any of them; ``burst_audit`` has the true
    number. Run it on the rows before burst removal.
    """
    local = F.col("event_local")
    daily = (
        events.where(F.col("user_uuid").isNotNull() & F.col("event_name").isNotNull()
                     & local.isNotNull())
        .groupBy(*KEYS, local.cast("date").alias("_date"))
        .agg(F.min("event_local").alias("_first"), F.max("event_local").alias("_last"),
             F.count(F.lit(1)).alias("frequency"))
        .select(
            *KEYS,
            F.col("_date").cast("string").alias("event_date"),
            times.time_text(F.col("_first")).alias("start_time"),
            times.time_text(F.col("_last")).alias("end_time"),
            "frequency",
            (F.col("frequency") - 1).alias("repetitions_removed"),
            times.weekday_name(F.col("_date")).alias("event_day"),
        )
        .select(*REPETITION_SCHEMA.fieldNames())
    )
    return daily.where("repetitions_removed > 0") if repeated_only else daily


def burst_audit(events: DataFrame, threshold_ms=BURST_MS) -> DataFrame:
    """One row per burst: start, end, size and the number of events removed.

    Events are counted per cell as in ``remove_bursts``; cells are then chained
    within blocks of consecutive cells, and the burst still open at the end of a
    block is handed to the next one.
    """
    limit = threshold_micros(threshold_ms)
    cells = (
        events.where(F.col("user_uuid").isNotNull() & F.col("event_name").isNotNull()
                     & F.col("event_time").isNotNull())
        .select(*KEYS, F.unix_micros("event_time").alias("_us"))
        .groupBy(*KEYS, times.floor_to(F.col("_us"), limit + 1).alias("_cell"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"),
             F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", times.floor_to(F.col("_cell"), (limit + 1) * CELLS_PER_BLOCK))
    )
    in_block = W.partitionBy(*KEYS, "_block").orderBy("_cell")
    up_to_here = in_block.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.lag("_last").over(in_block)
    cells = cells.withColumn(
        "_start", F.when(F.col("_first") - before > limit, F.col("_first")))

    per_key = W.partitionBy(*KEYS).orderBy("_block")
    earlier = per_key.rowsBetween(W.unboundedPreceding, -1)
    last_before = F.lag("_last").over(per_key)
    blocks = (
        cells.groupBy(*KEYS, "_block")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"),
             F.max("_start").alias("_inner"))
        .withColumn("_new", F.when(last_before.isNull()
                                   | (F.col("_first") - last_before > limit), F.col("_first")))
        .withColumn("_open", F.max(F.coalesce("_inner", "_new")).over(earlier))
        .select(*KEYS, "_block", F.coalesce("_new", "_open").alias("_head"))
    )
    return (
        cells.withColumn("_start", F.max("_start").over(up_to_here))
        .join(blocks, KEYS + ["_block"])
        .groupBy(*KEYS, F.coalesce("_start", "_head").alias("_burst"))
        .agg(F.max("_last").alias("_last"), F.sum("_n").alias("burst_size"))
        .select(
            *KEYS,
            F.timestamp_micros("_burst").alias("burst_start"),
            F.timestamp_micros("_last").alias("burst_end"),
            "burst_size",
            (F.col("burst_size") - 1).alias("removed"),
        )
    )
