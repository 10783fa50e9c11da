"""Other event tables as frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.frames import encode_raw, prim_time, wire_size


def frames_from_events(events: DataFrame, raw: bool = False) -> DataFrame:
    """Events (event_id, ts, user_id, event_type, value, props) as one source in presented order. The numbers keep their
    columns; as frames the rows are JSON ones, whose payload is ``props``. ``raw`` adds the wire bytes."""
    tm = prim_time(F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    payload = F.encode("props", "UTF-8")
    f = events.select(
        F.lit("events").alias("source_id"), F.col("event_id").alias("seq"), tm.alias("tm_ns"), F.lit(7).cast("tinyint").alias("pti"), F.lit(14).alias("evtnum"),
        F.col("value").alias("v0"), F.col("user_id").alias("v1"), (F.octet_length("props") + 1).cast("long").alias("ucount"), payload.alias("payload"), F.col("event_type").alias("stream_name"), "props",
    )
    f = f.withColumn("nbytes", wire_size(F.col("pti"), F.col("ucount")))
    return f.withColumn("raw", encode_raw("tm_ns", "evtnum", "v0", "v1", "payload")) if raw else f
