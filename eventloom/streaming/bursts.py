"""Burst removal on a stream."""

from pyspark.sql import DataFrame, functions as F

from eventloom.operators.cleaning import (
    KEYS, first_of_bursts, is_keyless, threshold_micros, whole_row)
from eventloom.schema import BURST_MS


def remove_bursts_stream(events: DataFrame, delay: str = "10 minutes",
                         threshold_ms=BURST_MS) -> DataFrame:
    """The aggregation of the batch operator under a watermark. State is kept per
    cell, so a heavy key spreads over the state partitions, and is dropped once
    the watermark has passed the cell. An event comes out when its cell is
    complete. Events without user, name or time pass straight through.
    """
    width = threshold_micros(threshold_ms) + 1
    # A window of two cells at every cell: its second half is the own cell.
    pair = F.window("event_time", f"{2 * width} microseconds", f"{width} microseconds")
    second_half = F.col("_pair.start") + F.expr(f"interval {width} microseconds")
    rows = (
        events.where(~is_keyless()).withWatermark("event_time", delay)
        .select(*KEYS, "event_time", whole_row(events))
        .withColumn("_pair", pair)
        .withColumn("_own", F.col("event_time") >= second_half)
    )
    firsts = first_of_bursts(rows, threshold_ms, ["_pair", *KEYS])
    return firsts.select(*events.columns).unionByName(events.where(is_keyless()))
