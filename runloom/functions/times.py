"""Days, weeks and ranges as column expressions, in the session's time zone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.config import Range


def in_range(time: Column, span: Range) -> Column:
    """Whether a time lies in the half-open range."""
    if not span.bounded:
        return F.lit(True)
    return (time >= F.lit(span.start)) & (time < F.lit(span.end))


def in_months(month: Column, span: Range) -> Column:
    """Whether a month (yyyy-MM) may hold times of the range: one day to spare on both sides, as another session may have named the months in its own time zone."""
    if not span.bounded:
        return F.lit(True)
    return month.between(f"{span.start - timedelta(1):%Y-%m}", f"{span.end:%Y-%m}")


def day_key(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def week_key(time: Column) -> Column:
    """The Monday of the week."""
    return F.date_format(F.date_trunc("WEEK", time), "yyyy-MM-dd")


def bucket_key(time: Column, weekly: bool) -> Column:
    return week_key(time) if weekly else day_key(time)


def bucket_label(key: Column, weekly: bool) -> Column:
    short = F.substring(key, 6, 5)
    return F.concat(F.lit("Week of "), short) if weekly else short


def from_epoch(ms: Column, seconds: Column) -> Column:
    """The time in milliseconds if there is one, else in seconds, else the epoch."""
    return F.timestamp_millis(F.when(ms > 0, ms.cast("long")).when(seconds > 0, (seconds * 1000).cast("long")).otherwise(F.lit(0).cast("long")))


def millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))
