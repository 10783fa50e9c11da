"""Nanosecond time as LONG: no division ever goes through a double."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.schema import DAY_NS, MINUTE_NS


def floor_to(tm: Column, width_ns: int | Column) -> Column:
    """Start of the period of ``width_ns`` (aligned to the epoch) that holds ``tm``; also right before 1970."""
    width = F.lit(width_ns) if isinstance(width_ns, int) else width_ns
    return tm - F.pmod(tm, width)


def whole_div(a: Column, b: int | Column) -> Column:
    """Integer division of LONGs."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def utc_day(tm: Column) -> Column:
    """Days since the epoch, LONG."""
    return whole_div(floor_to(tm, DAY_NS), DAY_NS)


def day_text(day: Column) -> Column:
    """``YYYY/MM/DD`` of days since the epoch."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy/MM/dd")


def minute_floor(tm: Column) -> Column:
    return floor_to(tm, MINUTE_NS)
