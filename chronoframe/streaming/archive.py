"""Archiving a stream of frames by UTC day and stream, with acknowledgements; replaying it; following files."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chronoframe.functions import paths
from chronoframe.functions.dates import date_of_ns, date_text
from chronoframe.operators.compaction import write_packs
from chronoframe.operators.ordering import merge
from chronoframe.sources.frames import FORMAT, register


def event_time(data: Column, arrived_ns: Column) -> Column:
    """Nanoseconds of the first eight bytes where there are so many, else the time of arrival."""
    high, low = (F.conv(F.concat(*(F.hex(F.substring(data, k, 1)) for k in places)), 16, 10).cast("long") for places in ((8, 7, 6, 5), (4, 3, 2, 1)))
    return F.when(F.octet_length(data) >= 8, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(arrived_ns)


def archived(messages: DataFrame, service: str) -> DataFrame:
    """Messages (subject, reply, data) with the place they are stored at: stream, id, tm_ns, year, month, day. Messages
    of other subjects and empty ones are left out; late ones go to their own day."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    m = messages.select("*", paths.subject_stream(F.col("subject"), service).alias("stream"), paths.subject_id(F.col("subject"), service).alias("id"))
    m = m.where("stream <> '' and octet_length(data) > 0").withColumn("tm_ns", event_time(F.col("data"), now))
    d = date_of_ns(F.col("tm_ns"))
    return m.select("*", F.date_format(d, "yyyy").alias("year"), F.date_format(d, "MM").alias("month"), F.date_format(d, "dd").alias("day"))


def acknowledgements(stored: DataFrame, service: str) -> DataFrame:
    """What is published once data is stored, for messages with a reply address: subject and data (the id)."""
    asked = stored.where("reply is not null and reply <> ''")
    direct = asked.select(F.col("reply").alias("subject"), F.col("id").alias("data"))
    return direct.unionByName(asked.select(F.concat(F.lit(f"{service}.storage-ack."), "stream").alias("subject"), F.col("id").alias("data")))


def archive(messages: DataFrame, directory: str, checkpoint: str, service: str, acknowledge: Callable[[DataFrame, int], None] | None = None, every: str | None = "1 minute", layout: str = "parquet") -> StreamingQuery:
    """Store a stream of messages under ``directory`` by year, month, day and stream. Acknowledgements follow the data.
    No watermark: late data is always accepted. ``every`` None handles what is there and stops.

    ``parquet``: each batch has its own folder and replaces it when repeated. ``frames``: each batch adds one frame
    file per day and stream, ``YYYY/MM/DD/<stream>/pack-<batch>``, renamed into place, which the frame source reads and
    compaction folds. Either way a repeated batch stores nothing twice."""
    if layout not in ("parquet", "frames"):
        raise ValueError(f"unknown layout {layout!r}")

    def store(batch: DataFrame, number: int) -> None:
        placed = archived(batch, service).persist()
        try:
            place = ["year", "month", "day", "stream"]
            if layout == "frames":
                day = F.concat_ws("/", "year", "month", "day")
                packs = placed.select(F.col("stream").alias("stream_name"), day.alias("file_day"), F.lit(number).cast("long").alias("pack"), F.octet_length("data").alias("nbytes"), F.col("data").alias("raw"), "tm_ns", "id")
                write_packs(packs, directory, "tm_ns", "id").count()
            else:
                placed.select(*place, "tm_ns", "id", F.col("data").alias("raw")).repartition(*place).sortWithinPartitions(*place, "tm_ns").write.mode("overwrite").partitionBy(*place).parquet(f"{directory}/batch={number:09d}")
            if acknowledge is not None:
                acknowledge(acknowledgements(placed, service), number)
        finally:
            placed.unpersist()

    w = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read_archive(spark: SparkSession, directory: str) -> DataFrame:
    """Stored messages, with their place as partition columns (texts), so that filters on them prune folders."""
    return spark.read.schema("tm_ns long, id string, raw binary, batch string, year string, month string, day string, stream string").parquet(directory)


def available_days(directory: str) -> list[str]:
    """Sorted days ``YYYY/MM/DD`` of an archive in either layout: nested date directories, or partition folders."""
    import re

    date = re.compile(r"^(?:year=|month=|day=)?([23][0-9]{3}|0[1-9]|[12][0-9]|3[01])$")

    def children(path: str) -> list[tuple[str, str]]:
        return sorted((m[1], e.path) for e in os.scandir(path) if e.is_dir() and (m := date.match(e.name)))

    if not os.path.isdir(directory):
        raise FileNotFoundError(directory)
    roots = [e.path for e in os.scandir(directory) if e.is_dir() and e.name.startswith("batch=")] or [directory]
    days = {f"{y}/{m}/{d}" for root in roots for y, yp in children(root) if len(y) == 4 for m, mp in children(yp) for d, _ in children(mp)}
    return sorted(days)


def intersect_days(days: list[str], begin: str, end: str | None = None) -> list[str]:
    """The available days in [begin, end); only ``begin`` without an end."""
    return [d for d in days if (d == begin if end is None else begin <= d < end)]


def replay(name: str, *sources: DataFrame, presorted: bool = True) -> DataFrame:
    """Frames of all sources merged by time, as messages: subject ``tseries.replay.<name>.<day>`` and data. Each frame
    is sent once."""
    day = date_text(date_of_ns(F.col("tm_ns")))
    return merge(*sources, presorted=presorted).select(paths.replay_subject(F.lit(name), day).alias("subject"), F.col("raw").alias("data"))


def follow(spark: SparkSession, path: str, starting_at: str = "end", columns: list[str] | None = None) -> DataFrame:
    """A stream of the frames appended to a file or to the files of a folder."""
    register(spark)
    r = spark.readStream.format(FORMAT).option("path", path).option("startingAt", starting_at)
    return (r.option("columns", ",".join(columns)) if columns else r).load()

