"""Subjects, archive paths and date directories."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.times import day_text, utc_day

# Fixed value: the prefix of replayed subjects.
REPLAY_PREFIX = "tseries.replay"


def subject_stream(subject: Column, service: str) -> Column:
    """Stream of ``<service>.archive.<stream>[.<id>]``; '' for any other subject."""
    return F.when(_is_archive(subject, service), F.element_at(F.split(subject, r"\."), 3)).otherwise("")


def subject_id(subject: Column, service: str) -> Column:
    """Everything after the stream of an archive subject, '' if nothing follows."""
    parts = F.split(subject, r"\.")
    return F.when(_is_archive(subject, service) & (F.size(parts) > 3), F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), ".")).otherwise("")


def _is_archive(subject: Column, service: str) -> Column:
    parts = F.split(subject, r"\.")
    return (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == service) & (F.get(parts, F.lit(1)) == "archive")


def replay_subject(name: Column, day: Column) -> Column:
    return F.concat_ws(".", F.lit(REPLAY_PREFIX), name, day)


def archive_path(root: str, tm: Column, stream: Column) -> Column:
    """``<root>/YYYY/MM/DD/<stream>``."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), day_text(utc_day(tm)), stream)


def xtra_dirs(name: Column) -> Column:
    """``a/b/c/name/`` from the first three letters; null for shorter names."""
    return F.when(F.length(name) >= 3, F.concat_ws("/", *(F.substring(name, k, 1) for k in (1, 2, 3)), name, F.lit("")))


def chomp_slash(path: Column) -> Column:
    return F.regexp_replace(path, "/$", "")


def is_date_dir(name: Column) -> Column:
    """Year (2000..3999), month or day directory; '00' is none."""
    return name.rlike("^([23][0-9]{3}|0[1-9]|[12][0-9]|3[01])$")
