"""Runs of identical or nearly identical consecutive events, collapsed into one row with count and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.times import utc_day, whole_div
from chronoframe.schema import HOUR_NS, PTI_FLOAT, PTI_FLOAT_INT, PTI_UDE


def _same(pti, v0, last_pti, last_v0):
    """Whether a frame repeats the one before: equal pti and, where there is a v0, an equal one or one within the
    deadband. NaN and null repeat nothing."""
    number = F.col(pti).isin(PTI_FLOAT, PTI_FLOAT_INT)
    near = (F.col(v0) == last_v0) | (F.abs(F.col(v0) - last_v0) <= F.col("deadband"))
    real = ~F.isnan(v0) & ~F.isnan(last_v0)
    return F.coalesce((F.col(pti) == last_pti) & (~number | (real & F.coalesce(near, F.lit(False)))), F.lit(False))


def collapse_runs(frames: DataFrame, config: DataFrame, least: int = 3, slice_ns: int = HOUR_NS) -> DataFrame:
    """The runs of ``least`` or more distinct frames (by raw) with pti 0..6 of each stream's UTC day in order of time:
    stream_name, start_ns, end_ns, n_frames. Ties of tm_ns are ordered by raw; frames without tm_ns, pti or raw take
    no part; streams without a deadband need equal values; a run never crosses midnight.

    Each event is made canonical: its pti and value, or, where a deadband makes near values equal, the first event of its
    chain of near-equal ones. The row number among all events less the row number among those of the same canonical
    event is then constant along a run and no other run of that event has it. This is done per slice of time, so that a
    hot stream's day is spread over many tasks; only the first and last run of a slice meet those of other slices."""
    band = config.groupBy("stream_name").agg(F.max("deadband").alias("deadband"))
    events = (
        frames.where((F.col("pti") >= 0) & (F.col("pti") < PTI_UDE) & F.col("tm_ns").isNotNull() & F.col("raw").isNotNull())
        .select("stream_name", utc_day(F.col("tm_ns")).alias("day"), whole_div(F.col("tm_ns") - F.pmod("tm_ns", F.lit(slice_ns)), slice_ns).alias("slice"), "tm_ns", "pti", "v0", "raw")
        .join(band, "stream_name", "left")
        .withColumn("place", F.xxhash64("stream_name", "day", "slice"))
    )
    part = ["place", "stream_name", "day", "slice"]
    w = Window.partitionBy(*part).orderBy("tm_ns", "raw")
    distinct = events.withColumn("dup", F.coalesce(F.lag("raw").over(w) == F.col("raw"), F.lit(False))).where("not dup").drop("dup")
    chained = distinct.withColumn("near", _same("pti", "v0", F.lag("pti").over(w), F.lag("v0").over(w)))
    number = F.col("pti").isin(PTI_FLOAT, PTI_FLOAT_INT)
    real = F.col("v0").isNotNull() & ~F.isnan("v0")
    chain = F.last(F.when(~F.col("near"), F.struct("v0", "raw")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    canonical = (
        F.when(number & ~real, F.struct(F.lit(None).cast("double").alias("v0"), F.col("raw").alias("raw")))  # like nothing else
        .when(number & (F.col("deadband") > 0), F.col("chain"))
        .when(number, F.struct(F.col("v0"), F.lit(None).cast("binary").alias("raw")))
    )
    named = chained.withColumns({"chain": chain, "at": F.row_number().over(w), "final": F.lead("raw").over(w).isNull()}).withColumn("event", canonical)
    alike = Window.partitionBy(*part, "pti", "event").orderBy("tm_ns", "raw")
    runs = (
        named.withColumn("run", F.col("at") - F.row_number().over(alike))
        .groupBy(*part, "pti", "event", "run")
        .agg(
            F.min("tm_ns").alias("start_ns"),
            F.max("tm_ns").alias("end_ns"),
            F.count("*").alias("n"),
            F.min("at").alias("at"),
            F.max("final").alias("closes"),
            F.first("deadband").alias("deadband"),
            F.min_by("v0", "at").alias("v0"),
            F.max_by("v0", "at").alias("tail_v0"),
        )
        .withColumn("opens", F.col("at") == 1)
        .where(F.col("opens") | F.col("closes") | (F.col("n") >= least))
        .withColumn("inner", F.when(~(F.col("opens") | F.col("closes")), F.struct("slice", "at")))
    )
    # the runs at the edges of slices in one group per stream and day, every other one in a group of its own
    day = Window.partitionBy("stream_name", "day", "inner").orderBy("slice", "at")
    joined = (
        runs.withColumn("continues", F.col("opens") & _same("pti", "v0", F.lag("pti").over(day), F.lag("tail_v0").over(day)))
        .withColumn("whole", F.row_number().over(day) - F.count_if("continues").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return (
        joined.groupBy("stream_name", "day", "inner", "whole")
        .agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("n").alias("n_frames"))
        .where(F.col("n_frames") >= least)
        .select("stream_name", "start_ns", "end_ns", "n_frames")
    )
