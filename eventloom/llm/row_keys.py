"""Hash keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hashed before the values, this makes the second half a hash of its own.
SECOND = "second"


def row_key(*values: Column) -> Column:
    """128-bit hash (one, two) of some values, so that no two of 10**10 rows are expected to share one.
    The hash alone passes over nulls, so that (null, '5') and ('5', null) would be one; each value
    is therefore hashed with whether it is null."""
    parts = [part for value in values for part in (value.isNull(), value)]
    return F.struct(F.xxhash64(*parts).alias("one"), F.xxhash64(F.lit(SECOND), *parts).alias("two"))
