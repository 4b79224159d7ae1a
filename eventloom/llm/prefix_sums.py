"""Running totals over long orders, in levels, so that no window spans a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = (4096, 4096)


def running_totals(frame: DataFrame, keys: list[str], place: str, ties: list[str | Column], value: str,
                   out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, within ``keys``, ordered by
    ``place`` (a long from 0 to 2**48 - 1) and, for equal places, by ``ties``.

    Places are cut into 4096 ranges, each into 4096 again. Rows are summed on the map side
    per range; running totals go over at most 4096 ranges at each level, and single rows
    are ordered only within the finest range."""
    first, second = LEVELS
    step = (1 << 48) // first
    cut = (frame.withColumn("_l1", F.floor(F.col(place) / F.lit(step)).cast("int"))
           .withColumn("_l2", F.floor((F.col(place) % F.lit(step)) / F.lit(step // second)).cast("int")))
    leaves = cut.groupBy(*keys, "_l1", "_l2").agg(F.sum(value).alias("_n"))
    tops = leaves.groupBy(*keys, "_l1").agg(F.sum("_n").alias("_n"))

    def before(table, parts, order):
        window = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    tops = tops.select(*keys, "_l1", before(tops, keys, "_l1").alias("_b1"))
    leaves = leaves.select(*keys, "_l1", "_l2", before(leaves, [*keys, "_l1"], "_l2").alias("_b2"))

    def match(left, right, names):
        renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
        condition = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
        return left.join(renamed, condition).drop(*[f"_r_{n}" for n in names])

    starts = match(leaves, tops, [*keys, "_l1"])
    joined = match(cut, starts, [*keys, "_l1", "_l2"])
    within = Window.partitionBy(*keys, "_l1", "_l2").orderBy(place, *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(out, F.col("_b1") + F.col("_b2") + own).drop("_l1", "_l2", "_b1", "_b2")
