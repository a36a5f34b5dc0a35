"""Expressions over times. All of them are independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds (number or text) to a timestamp without zone, half to even."""
    whole = F.bround(seconds.try_cast("double"), 0).try_cast("bigint")
    return F.timestamp_add("SECOND", whole, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_timestamp(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def date_time(creation_date: Column, epoch_seconds: Column) -> Column:
    """Creation date of the sample, else the clock of the report."""
    return F.coalesce(parse_timestamp(creation_date), epoch_to_timestamp(epoch_seconds))


def time_of_day(ts: Column) -> Column:
    """Time part as text with microseconds (there is no column type for it)."""
    text = ts.cast("string")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.concat(F.substring(text, 12, 8), F.lit("."), fraction)


def format_second(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``. Date formats would go by way of the session zone."""
    return F.left(ts.cast("string"), F.lit(19))


def format_minute(ts: Column) -> Column:
    return F.left(ts.cast("string"), F.lit(16))
