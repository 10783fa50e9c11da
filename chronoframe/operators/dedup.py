"""Duplicate removal over a window of frames in presented order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.text import stringify
from chronoframe.schema import DuplicateDetected

DEFAULT_WINDOW = 1000


def mark_duplicates(frames: DataFrame, window: int = DEFAULT_WINDOW, key: list[str] | None = None, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """``is_dup``: an equal frame (by ``key``, default ``raw``) lies among the ``window`` frames before it in its
    source. Duplicates count and extend the window. ``seq`` must be dense. Partitions by key, never by source alone,
    so one long source is spread over all tasks. Null keys are equal to each other."""
    if window <= 1:
        raise ValueError("window must be larger than 1")
    w = Window.partitionBy(*(by or []), *(key or ["raw"])).orderBy(seq)
    return frames.withColumn("is_dup", F.coalesce(F.col(seq) - F.lag(seq).over(w) <= window, F.lit(False)))


def dedup(frames: DataFrame, window: int = DEFAULT_WINDOW, key: list[str] | None = None, by: list[str] | None = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(frames kept, duplicates)."""
    marked = mark_duplicates(frames, window, key, by, seq)
    return marked.where("not is_dup").drop("is_dup"), marked.where("is_dup").drop("is_dup")


def first_duplicate(frames: DataFrame, window: int = DEFAULT_WINDOW, key: list[str] | None = None, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """The first duplicate in presented order, if any."""
    return dedup(frames, window, key, by, seq)[1].orderBy(*(by or []), seq).limit(1)


def require_unique(frames: DataFrame, window: int = DEFAULT_WINDOW) -> None:
    """Raise `DuplicateDetected` with the first duplicate's line."""
    number: Column = F.col("seq")
    for row in first_duplicate(frames, window).select(stringify(number, skip_payload=True).alias("line")).collect():
        raise DuplicateDetected(row.line)
