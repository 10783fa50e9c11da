"""Counts per interval with zero fill, and sparse time indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.times import whole_div
from chronoframe.operators.arrow import bounds
from chronoframe.operators.ordering import running_max
from chronoframe.schema import MINUTE_NS


def count_per(frames: DataFrame, interval_ns: int = MINUTE_NS, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Frames per interval: window, end_ns, n. The windows of a source start at its first presented frame: window 0
    covers [t0, t0 + interval], window k (t0 + k interval, t0 + (k + 1) interval]. A late frame counts in the window that
    is current when it is presented; empty windows up to the last have 0. No frames give no windows."""
    by = by or []
    f = frames.where(F.col("tm_ns").isNotNull()).select(*by, "tm_ns", F.col(seq).alias("seq"))
    first = f.groupBy(*by).agg(F.min_by("tm_ns", "seq").alias("t0"))
    run = running_max(f, "tm_ns", "seq", by)
    joined = run.crossJoin(F.broadcast(first)) if not by else run.join(first, by)
    k = F.greatest(whole_div(F.col("run_max") - F.col("t0") + (interval_ns - 1), interval_ns) - 1, F.lit(0).cast("long"))
    counts = joined.groupBy(*by, k.alias("window")).agg(F.count("*").alias("n"))
    last = counts.groupBy(*by).agg(F.max("window").alias("last")).where("last is not null")
    span = last.crossJoin(F.broadcast(first)) if not by else last.join(first, by)
    windows = span.select(*by, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("window"))
    return windows.join(counts, [*by, "window"], "left").select(*by, "window", (F.col("t0") + (F.col("window") + 1) * interval_ns).alias("end_ns"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _index(interval: int):
    """Kernel over a source's frames in presented order: an entry for the first frame, then for each one later than the
    start of the interval after the last entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, due = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tm = batch.column("tm_ns").to_numpy()
            edges = bounds(batch, ["source_id"])
            heads = batch.column("source_id").take(pa.array(edges[:-1], pa.int64())).to_pylist()
            taken: list[int] = []
            for s, e, head in zip(edges, edges[1:], heads):
                if due is None or head != ident:
                    ident, due = head, None
                at = s
                while at < e:
                    if due is not None:
                        later = np.flatnonzero(tm[at:e] > due) if e - at <= 256 else _next(tm, at, e, due)
                        if not len(later):
                            break
                        at += int(later[0])
                    taken.append(at)
                    due = int(tm[at]) - int(tm[at]) % interval + interval
                    at += 1
            yield batch.take(pa.array(taken, pa.int64())).select(["source_id", "seq", "tm_ns", "byte_offset"])

    return run


def _next(tm: np.ndarray, at: int, end: int, due: int) -> np.ndarray:
    """First place past ``at`` with a time beyond ``due``, looked for in growing steps."""
    step, start = 256, at
    while start < end:
        hit = np.flatnonzero(tm[start : start + step] > due)[:1]
        if len(hit):
            return hit + (start - at)
        start, step = start + step, step * 2
    return np.empty(0, int)


def time_index(frames: DataFrame, interval_ns: int = MINUTE_NS) -> DataFrame:
    """Sparse index of each source: source_id, seq, tm_ns, byte_offset of the first frame and of each frame strictly
    later than the start of the interval after the last entry (a frame exactly on a boundary is no entry)."""
    f = frames.where("tm_ns is not null").select("source_id", "seq", "tm_ns", "byte_offset")
    return f.repartition("source_id").sortWithinPartitions("source_id", "seq").mapInArrow(_index(interval_ns), f.schema)


def index_frames(index: DataFrame) -> DataFrame:
    """The index in its stored form: integer frames of time and byte offset."""
    from chronoframe.functions.frames import to_frames

    return to_frames(index.withColumn("_e", F.lit(1)), "tm_ns", "_e", v1="byte_offset", source="source_id", seq="seq")


def write_indexes(index: DataFrame) -> DataFrame:
    """Write each source's index beside it, as ``<source>.idx``; yields the paths and numbers of entries. A file is
    renamed into place, so a repeated task replaces it."""
    from chronoframe import codec
    from chronoframe.files import Output, attempt_name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = attempt_name()
        path, sink, n, done = None, None, 0, []

        def close() -> None:
            if sink is not None:
                done.append((sink.publish(), n))

        for batch in batches:
            for row in batch.to_pylist():
                if path != row["source_id"] + ".idx":
                    close()
                    path, n = row["source_id"] + ".idx", 0
                    folder, _, last = path.rpartition("/")
                    sink = Output(folder, last, attempt)
                sink.write(codec.pack(row["tm_ns"], 1, v1=row["byte_offset"]))
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n"])

    return index.repartition("source_id").sortWithinPartitions("source_id", "seq").mapInArrow(run, "path string, n long")


def checksums(frames: DataFrame) -> DataFrame:
    """Each frame's time with the checksum of its content: source_id, seq, tm_ns, v1."""
    from chronoframe.functions.frames import checksum64

    return frames.select("source_id", "seq", "tm_ns", checksum64("raw").alias("v1"))
