"""Cutting the list of items of a user or session into parts of bounded size.

Tables of parts are only ever joined on the owner *and* the part, so the parts
of one large owner stay spread out.
"""

from pyspark.sql import Column, DataFrame, functions as F


def part_of(place: Column, items_per_part: int) -> Column:
    """Part, from 1, of the item at a place counted from 1."""
    return F.floor((place - 1) / items_per_part) + 1


def with_parts(owners: DataFrame, count: Column, items_per_part: int) -> DataFrame:
    """Repeat each row for every part its number of items needs, at least once."""
    parts = F.greatest(F.ceil(count / items_per_part), F.lit(1))
    return owners.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), parts)))


def in_sequence(order: Column, item: Column) -> Column:
    """Aggregate: items of a group as an array in ascending order."""
    pairs = F.collect_list(F.struct(order.alias("at"), item.alias("item")))
    return F.transform(F.array_sort(pairs), lambda pair: pair["item"])
