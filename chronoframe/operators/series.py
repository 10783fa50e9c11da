"""Point-in-time search as an as-of join: strict or inclusive, first or last of tied rows.

No range join: probes and series rows are sorted together. Time is cut into buckets; inside a bucket a window carries
the latest series row forward, and what is in force at a bucket's start comes from a small table of bucket ends. So one
long series without a key is spread over many tasks like many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.frames import prim_time
from chronoframe.functions.times import floor_to
from chronoframe.schema import DAY_NS

IN_PAST, AVAIL, IN_FUTURE = "InPast", "Avail", "InFuture"


def asof(
    probes: DataFrame, series: DataFrame, by: list[str] | None = None, strict: bool = False, tie: str = "last",
    tm: str = "tm_ns", seq: str = "seq", bucket_ns: int = DAY_NS, quantise: bool = True,
) -> DataFrame:
    """Each probe with the series row in force: its columns prefixed ``f_``, ``status`` and ``index``.

    ``strict`` looks before the probe's time, else at or before. ``tie`` picks the first or last of rows of equal time,
    in order of ``seq``. Probe times are floored to 8 ns like stored ones. ``index`` is the found row's place in order
    of (time, seq), -1 if none. ``status`` is InFuture if the probe is later than every row, InPast if no row is in
    force, else Avail; an empty series gives InPast. Probes without a time find nothing; repeated probes each keep
    their row; series rows without a time take no part."""
    by = by or []
    own = [c for c in series.columns if c not in by]
    n_before = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(tm, seq)) - 1
    s = series.where(F.col(tm).isNotNull()).withColumn("_bucket", floor_to(F.col(tm), bucket_ns)).withColumn("_i", n_before)
    pick = F.struct(F.col(seq), F.col("_i"), *[F.col(c).alias(f"f_{c}") for c in own])
    best = F.min(pick) if tie == "first" and _comparable(series, own) else F.max(pick) if _comparable(series, own) else (F.min_by if tie == "first" else F.max_by)(pick, F.col(seq))
    ties = s.groupBy(*by, "_bucket", F.col(tm).alias("_t")).agg(best.alias("_row"), F.count("*").alias("_n"))
    ends = ties.groupBy(*by, "_bucket").agg(F.max_by("_row", "_t").alias("_last"), F.sum("_n").alias("_n"), F.max("_t").alias("_max"))
    probe_columns = probes.columns
    p = probes.withColumn("_t", prim_time(F.col(tm)) if quantise else F.col(tm)).withColumn("_bucket", floor_to(F.col("_t"), bucket_ns))
    # what was in force when each bucket began: the bucket ends, in order, also for buckets that only hold probes
    marks = ends.select(*by, "_bucket", "_last", "_n", "_max").unionByName(p.where("_t is not null").select(*by, "_bucket").distinct(), allowMissingColumns=True)
    marks = marks.groupBy(*by, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"), F.sum("_n").alias("_n"), F.max("_max").alias("_max"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    whole = Window.partitionBy(*by)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    marks = marks.withColumn("_offset", offset)
    carried = F.last(F.when(F.col("_last").isNotNull(), F.struct("_last", F.col("_offset").alias("_at"))), ignorenulls=True).over(before)
    marks = marks.select(*by, "_bucket", "_offset", carried.alias("_carried"), F.max("_max").over(whole).alias("_latest"))
    side_series, side_probe = (1, 0) if strict else (0, 1)
    tagged_s = ties.select(*by, "_bucket", "_t", F.lit(side_series).alias("_side"), "_row", F.lit(None).cast(p.select(F.struct(*probe_columns).alias("x")).schema["x"].dataType).alias("_probe"))
    tagged_p = p.select(*by, "_bucket", "_t", F.lit(side_probe).alias("_side"), F.lit(None).cast(ties.schema["_row"].dataType).alias("_row"), F.struct(*probe_columns).alias("_probe"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged_s.unionByName(tagged_p).withColumn("_in", F.last("_row", ignorenulls=True).over(inside)).where("_probe is not null")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_bucket"]]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    j = both.alias("b").join(marks.alias("m"), cond, "left")
    found = F.coalesce(F.col("b._in"), F.col("m._carried._last"))
    start = F.when(F.col("b._in").isNotNull(), F.col("m._offset")).otherwise(F.col("m._carried._at"))
    j = j.select("b._probe", F.col("b._t").alias("_t"), found.alias("_found"), start.alias("_start"), F.col("m._latest").alias("_latest"))
    status = F.when(F.col("_t") > F.col("_latest"), IN_FUTURE).when(F.col("_found").isNull(), IN_PAST).otherwise(AVAIL)
    return j.select(
        *[F.col(f"_probe.{c}").alias(c) for c in probe_columns],
        *[F.col(f"_found.f_{c}").alias(f"f_{c}") for c in own],
        status.alias("status"),
        F.coalesce(F.col("_start") + F.col("_found._i"), F.lit(-1)).cast("long").alias("index"),
    )


def _comparable(df: DataFrame, columns: list[str]) -> bool:
    return not any("map" in t or "variant" in t for c, t in df.dtypes if c in columns)


def last_before(probes: DataFrame, series: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    return asof(probes, series, by, strict=True, tie="last", **kw)


def first_before(probes: DataFrame, series: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    return asof(probes, series, by, strict=True, tie="first", **kw)


def last_at_or_before(probes: DataFrame, series: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    return asof(probes, series, by, strict=False, tie="last", **kw)


def first_at_or_before(probes: DataFrame, series: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    return asof(probes, series, by, strict=False, tie="first", **kw)


class Series:
    """A frame table with its key, for repeated lookups."""

    def __init__(self, df: DataFrame, by: list[str] | None = None, tm: str = "tm_ns", seq: str = "seq") -> None:
        self.df, self.by, self.tm, self.seq = df, by or [], tm, seq

    def at(self, probes: DataFrame, strict: bool = False, tie: str = "last") -> DataFrame:
        return asof(probes, self.df, self.by, strict, tie, self.tm, self.seq)
