"""Stable time sort, merging of sources, slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.times import whole_div
from chronoframe.session import cut_lineage

BUCKET_ROWS = 1 << 20


def time_sort(frames: DataFrame, *ties: str) -> DataFrame:
    """Stable by time: equal times keep the presented order, which ``seq`` (after any other ``ties``) holds."""
    return frames.orderBy("tm_ns", *ties, "seq")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, with ``source_ord`` for the order of the sources."""
    return reduce(DataFrame.unionByName, [s.withColumn("source_ord", F.lit(i)) for i, s in enumerate(sources)])


def running_max(df: DataFrame, value: str, order: str, by: list[str] | None = None, name: str = "run_max", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Largest ``value`` up to each row in order of the dense number ``order``. Buckets of ``bucket_rows`` rows are
    scanned side by side; what came before a bucket is the largest of the buckets before, a small table."""
    by = by or []
    b = df.withColumn("_b", whole_div(F.col(order), bucket_rows))
    tops = b.groupBy(*by, "_b").agg(F.max(value).alias("_top"))
    tops = tops.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]], F.max("_top").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_b"]]
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    j = b.join(tops, reduce(lambda x, y: x & y, same), "left").withColumn(name, F.greatest(F.max(value).over(inside), "_before"))
    return j.select(*df.columns, name)


def merge_keys(frames: DataFrame, source: str = "source_ord") -> DataFrame:
    """``merge_tm``: the time by which a merge of unsorted sources takes a frame, the largest so far in its source."""
    return running_max(frames, "tm_ns", "seq", [source], "merge_tm")


def merge(*sources: DataFrame, presorted: bool = True) -> DataFrame:
    """Merge sources by time; ties go by the order of the sources, then presented order. Sources that are not sorted
    (``presorted=False``) are merged by their heads, so a late frame follows what its source presented before it."""
    all_rows = union_sources(*sources)
    if presorted:
        return all_rows.orderBy("tm_ns", "source_ord", "seq")
    return merge_keys(all_rows).orderBy("merge_tm", "source_ord", "seq").drop("merge_tm")


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Dense 0-based place in a global order without a single-task window: range-partitioned sort, then the number of
    rows in the partitions before. The sorted rows are written to the shared folder once."""
    # kept once, since a second evaluation may cut the ranges elsewhere
    placed = cut_lineage(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    starts = sizes.select(F.col("_p").alias("_q"), "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    return placed.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(name, F.col("_start") + F.col("_m") - F.col("_first")).select(*df.columns, name)


def slice_frames(frames: DataFrame, skip: int = 0, count: int = 0, seq: str = "seq") -> DataFrame:
    """Frames [skip, skip + count) of a source by their dense number; count 0 means to the end. Skipping past the end
    gives nothing."""
    c = F.col(seq) >= skip
    return frames.where(c & (F.col(seq) < skip + count) if count else c)


def head(frames: DataFrame, count: int, skip: int = 0, *ties: str) -> DataFrame:
    """The same over the order of time; each task keeps no more than ``skip + count`` rows."""
    return time_sort(frames, *ties).offset(skip).limit(count)


def last_n(frames: DataFrame, n: int, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """``last``: the ``n`` latest rows up to each one, oldest first (a bounded ring). Rows hold ``n`` others each, so ``n``
    must be small."""
    w = Window.partitionBy(*(by or [])).orderBy(seq).rowsBetween(-(n - 1), 0)
    return frames.withColumn("last", F.collect_list(F.struct(*frames.columns)).over(w))


def kth(ring: str, k: int):
    """k-th oldest (from 0) of a ring column; null beyond it."""
    return F.get(F.col(ring), F.lit(k))
