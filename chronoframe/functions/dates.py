"""Calendar dates: UTC days as DateType, written YYYY/MM/DD."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.times import utc_day

YEARS = (1970, 3000)
ZONES = ("America/Los_Angeles", "America/New_York", "Europe/London", "UTC")


def parse_date(text: Column) -> Column:
    """Date of ``Y/M/D`` (leading zeros optional). Year 1970..3000, month 1..12, day 1..31; a day past the month's end
    runs over into the next month. Anything else is null."""
    pattern = r"^([0-9]{1,4})/([0-9]{1,2})/([0-9]{1,2})$"
    y, m, d = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2, 3))
    ok = y.between(*YEARS) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.date_add(F.make_date(y, F.when(ok, m), F.lit(1)), d - 1))


def date_of_ns(tm: Column) -> Column:
    return F.date_from_unix_date(utc_day(tm).cast("int"))


def date_unix(day: Column) -> Column:
    """Seconds since the epoch at the day's start."""
    return F.unix_date(day).cast("long") * 86400


def date_text(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM/dd")


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM")


def next_date(day: Column) -> Column:
    return F.date_add(day, 1)


def prev_date(day: Column) -> Column:
    return F.date_add(day, -1)


def date_before(a: Column, b: Column) -> Column:
    return a < b


def date_after(a: Column, b: Column) -> Column:
    return a > b


def dates_equal(a: Column, b: Column) -> Column:
    return a == b


def to_timestamp_utc(day: Column) -> Column:
    return F.timestamp_seconds(date_unix(day))


def local_time(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def days_between(day: Column, begin: str, end: str | None = None) -> Column:
    """Whether ``day`` lies in [begin, end); only ``begin`` itself without an end. Texts as `parse_date` reads them."""
    b = parse_date(F.lit(begin))
    return (day >= b) & (day < parse_date(F.lit(end))) if end is not None else day == b
