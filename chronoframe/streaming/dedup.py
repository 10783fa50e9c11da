"""Duplicate removal over a window of frames on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronoframe.operators.dedup import DEFAULT_WINDOW

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS, STRETCH = 2048, 1 << 16


class WindowDedup(StatefulProcessor):
    """A bucket of sources, or of stretches of long ones. Per stretch: the last places of the different frames among its
    latest ``window``, by MD5. Frames further back can no longer make a duplicate, so that is all the state there is."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "source string, stretch long", "seqs binary, marks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        group, stretches = pd.MultiIndex.from_frame(pdf[["dedup_source", "dedup_stretch"]]).factorize()
        stretches = [(source, int(k)) for source, k in stretches]
        groups, seqs, marks = [], [], []
        for g, stretch in enumerate(stretches):
            known = self.recent.getValue(stretch)
            if known is not None:
                seqs.append(np.frombuffer(known[0], np.int64))
                marks.append(np.frombuffer(known[1], "S32"))
                groups.append(np.full(len(seqs[-1]), g))
        before = sum(map(len, seqs))
        g, s, m = (np.concatenate(x) for x in ([*groups, group], [*seqs, pdf["seq"].to_numpy(np.int64)], [*marks, pdf["dedup_mark"].to_numpy("S32")]))
        order = np.lexsort((s, m, g))
        g, s, m = g[order], s[order], m[order]
        same = (g[1:] == g[:-1]) & (m[1:] == m[:-1])
        is_dup = np.empty(len(s), bool)
        is_dup[order] = np.append(False, same & (s[1:] - s[:-1] <= self.window))
        top = np.full(len(stretches), np.iinfo(np.int64).min)
        np.maximum.at(top, g, s)
        kept = np.append(~same, True) & (s > top[g] - self.window)
        g, s, m = g[kept], s[kept], m[kept]
        ends = np.searchsorted(g, np.arange(len(stretches) + 1))
        for stretch, i, j in zip(stretches, ends, ends[1:]):
            self.recent.updateValue(stretch, (s[i:j].tobytes(), m[i:j].tobytes()))
        own = ~pdf["dedup_before"].to_numpy(bool)
        yield pdf.assign(is_dup=is_dup[before:])[own].drop(columns=["dedup_bucket", "dedup_source", "dedup_stretch", "dedup_mark", "dedup_before"])

    def close(self) -> None:
        pass


def mark_duplicates_stream(frames: DataFrame, window: int = DEFAULT_WINDOW, key: str = "raw", by: str = "source_id") -> DataFrame:
    """``is_dup`` for a stream of frames with a dense ``seq`` per source: an equal frame lies among the ``window`` before
    it. Many sources are handled in one call; a busy one is cut into stretches, spread over all tasks, that are also
    sent the ``window`` frames before them. Rows of one source and batch are put in order of ``seq``; a source's batches
    must follow each other. The session needs the RocksDB state store (``ROCKSDB``)."""
    from pyspark.sql import types as T

    out = T.StructType([*frames.schema.fields, T.StructField("is_dup", T.BooleanType())])
    long = max(STRETCH, 4 * window)
    k = F.call_function("div", F.col("seq"), F.lit(long))
    value = F.col(key) if isinstance(frames.schema[key].dataType, (T.BinaryType, T.StringType)) else F.col(key).cast("string")
    ready = frames.select(
        "*", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("dedup_source"), F.coalesce(F.md5(value), F.lit("null")).alias("dedup_mark"),
        F.explode(F.when(F.col("seq") % long >= long - window, F.array(k, k + 1)).otherwise(F.array(k))).alias("dedup_stretch"),
    )
    ready = ready.withColumn("dedup_before", F.col("dedup_stretch") > k).withColumn("dedup_bucket", F.pmod(F.xxhash64("dedup_source", "dedup_stretch"), F.lit(BUCKETS)).cast("int"))
    return ready.groupBy("dedup_bucket").transformWithStateInPandas(WindowDedup(window), out, "Append", "None")


def dedup_stream(frames: DataFrame, window: int = DEFAULT_WINDOW, key: str = "raw", by: str = "source_id") -> DataFrame:
    return mark_duplicates_stream(frames, window, key, by).where("not is_dup").drop("is_dup")
