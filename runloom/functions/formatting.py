"""Numbers and durations as text. Halves are rounded up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def as_integer(x: Column) -> Column:
    return F.format_number(half_up(F.coalesce(x, F.lit(0)).cast("double")), 0)


def _tenths(x: Column) -> Column:
    tenths = half_up(x * 10).cast("long")
    whole = (tenths - tenths % 10) / 10
    return F.concat(whole.cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def as_tokens(x: Column) -> Column:
    """1.2K and 3.4M from a thousand on."""
    x = x.cast("double")
    return F.when(x >= 1e6, F.concat(_tenths(x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(_tenths(x / 1e3), F.lit("K"))).otherwise(as_integer(x))


def as_decimal(x: Column) -> Column:
    """One decimal place at most, and commas."""
    tenths = half_up(F.coalesce(x, F.lit(0)).cast("double") * 10) / 10
    return F.call_function("format_number", tenths, F.lit("#,##0.#"))


def as_percent(share: Column) -> Column:
    return F.concat(as_decimal(F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0))) * 100), F.lit("%"))


def as_duration(ms: Column) -> Column:
    """Hours and minutes: 45m, 2h, 1h 5m."""
    minutes = F.greatest(F.lit(0), half_up(F.coalesce(ms, F.lit(0)).cast("double") / 60000)).cast("long")
    rest = minutes % 60
    hours = ((minutes - rest) / 60).cast("long")
    in_hours = F.concat(hours.cast("string"), F.lit("h"))
    in_minutes = F.concat(rest.cast("string"), F.lit("m"))
    return F.when(hours <= 0, in_minutes).when(rest == 0, in_hours).otherwise(F.concat(in_hours, F.lit(" "), in_minutes))


def as_date_time(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "M/d/yyyy, h:mm:ss a"), F.lit("Unavailable"))


def minutes_of(ms: Column) -> Column:
    return half_up(ms / 60000).cast("long")


def hours_of(ms: Column) -> Column:
    """Hours with two decimal places, for charts."""
    return half_up(ms / 36000.0) / 100
