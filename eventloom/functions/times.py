"""Wall-clock columns.

``event_local`` is TIMESTAMP_NTZ. ``date_format``, ``date_trunc`` and
``unix_micros`` would send it through the session time zone, where an hour lost
to daylight saving shifts it; the casts and field functions used here do not.
"""

from pyspark.sql import Column, functions as F

# English weekday names, Monday first as in weekday().
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SECONDS_PER_DAY = 86_400


def date_text(local: Column) -> Column:
    """``yyyy-MM-dd``."""
    return local.cast("date").cast("string")


def weekday_name(date: Column) -> Column:
    """Full English weekday of a date, or of a ``yyyy-MM-dd`` text."""
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return F.get(names, F.weekday(date.cast("date")))


def time_text(local: Column) -> Column:
    """``HH:MM:SS.ffffff``; the cast to text drops trailing zeros, so pad."""
    clock = F.substring_index(local.cast("string"), " ", -1)
    return F.when(F.length(clock) == 8, F.concat(clock, F.lit(".000000"))).otherwise(
        F.rpad(clock, 15, "0"))


def date_time_text(local: Column) -> Column:
    """``yyyy-MM-dd HH:MM:SS.ffffff``."""
    return F.concat(date_text(local), F.lit(" "), time_text(local))


def quoted_time(local: Column) -> Column:
    """Time with a leading apostrophe, so spreadsheets keep it as text."""
    return F.concat(F.lit("'"), time_text(local))


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("'"))


def clock_seconds(local: Column) -> Column:
    """``HH:MM:SS``."""
    return F.substring(time_text(local), 1, 8)


def clock_minutes(local: Column) -> Column:
    """``HH:MM``."""
    return F.substring(time_text(local), 1, 5)


def second_of_day(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def local_seconds(local: Column) -> Column:
    """Whole seconds from 1970-01-01 00:00:00 on the same wall clock."""
    days = F.datediff(local.cast("date"), F.lit("1970-01-01").cast("date"))
    return days.cast("bigint") * SECONDS_PER_DAY + second_of_day(local)


def local_micros(local: Column) -> Column:
    """Microseconds from 1970-01-01 00:00:00 on the same wall clock."""
    # The difference of two TIMESTAMP_NTZ is exact; only an interval of a single
    # unit can become a number.
    since = local - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = since.cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def floor_to(number: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above a whole number."""
    return number - F.pmod(number, F.lit(step))


def calendar(events):
    """Add the three derived columns of the cleaned table."""
    local = F.col("event_local")
    return events.withColumns({
        "event_date": date_text(local),
        "event_day": weekday_name(local),
        "event_time_only": quoted_time(local),
    })
