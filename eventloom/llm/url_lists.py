"""URL filters: captures judged against dated list entries, as they stood at fetch time.

Dated entries of a rule become validity intervals; an as-of join takes, for every capture,
the entry of each matching rule that was active when it was fetched, and the most specific
of them decides. Built from Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Intervals are cut at multiples of so many days, so that a capture meets only the entries
#: of its own stretch, however many a rule has had.
STRETCH_DAYS = 64
NO_END = "9999-12-31"


def host(url: str | Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.$", ""), F.lit(""))


def rules_of(host_col: str | Column) -> Column:
    """The rules that match a host: itself and every parent domain, the longest first."""
    labels = F.split(host_col, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(
        ".", F.slice(labels, k, F.size(labels) - k + 1)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(rule, entry_id, verdict, valid_from, valid_to) from (rule, entry_id, verdict, entry_date).

    An entry holds from its date to the day before the next of its rule. Of entries on one date
    the one with the largest entry_id (then verdict) holds. Entries without rule or date are void."""
    dated = entries.filter("rule is not null and entry_date is not null").groupBy("rule", "entry_date").agg(
        F.max(F.struct("entry_id", "verdict")).alias("entry"))
    later = F.lead("entry_date").over(Window.partitionBy("rule").orderBy("entry_date"))
    return dated.select("rule", "entry.entry_id", "entry.verdict", F.col("entry_date").alias("valid_from"),
                        F.coalesce(later, F.to_date(F.lit(NO_END))).alias("valid_to"))


def _stretch(day: Column) -> Column:
    return F.floor(F.unix_date(day) / STRETCH_DAYS)


def judged_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetch_date, rule, entry_id, verdict) for every capture (page_id, url, fetch_date).

    The longest rule with an entry active on the fetch date decides; without one, without a
    host or without a date, rule, entry and verdict are null. Rows that repeat are judged each."""
    intervals = validity_intervals(entries)
    # No interval reaches beyond the last capture: only then are the stretches bounded.
    last = F.lit(captures.agg(F.max("fetch_date")).first()[0]).cast("date")
    known = captures.select("page_id", "url", "fetch_date").withColumn("host", host("url"))
    asked = known.filter("host is not null and fetch_date is not null").select(
        "host", "fetch_date").distinct()
    asked = asked.withColumn("rule", F.explode(rules_of("host"))).withColumn(
        "stretch", _stretch(F.col("fetch_date")))
    bounded = intervals.filter(F.col("valid_from") <= last).withColumn(
        "until", F.least(F.date_sub("valid_to", 1), last))
    pieces = bounded.withColumn("stretch", F.explode(F.sequence(
        _stretch(F.col("valid_from")), _stretch(F.col("until"))))).drop("until")
    active = asked.join(pieces, ["rule", "stretch"]).filter(
        "fetch_date >= valid_from and fetch_date < valid_to")
    decided = active.groupBy("host", "fetch_date").agg(F.max(F.struct(
        F.length("rule").alias("length"), "rule", "entry_id", "verdict")).alias("best"))
    return known.join(decided, ["host", "fetch_date"], "left").select(
        "page_id", "host", "fetch_date", "best.rule", "best.entry_id", "best.verdict")
