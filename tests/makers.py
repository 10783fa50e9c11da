"""Small frame tables for tests."""

from chronoframe import codec
from chronoframe.schema import FRAME_SCHEMA

BASE = 1455580800000000000  # 2016-02-16T00:00:00Z


def frame(tm, evtnum=2, v0=0.0, v1=0, payload=None):
    return codec.pack(tm, evtnum, v0, v1, payload)


def frames_df(spark, raws):
    """A table of (stream, source, raw) triples; seq and offsets are given per source."""
    rows, seqs, offsets = [], {}, {}
    for stream, source, raw in raws:
        f = codec.unpack(raw)[0]
        seq, at = seqs.get(source, 0), offsets.get(source, 0)
        rows.append((source, seq, at, f["nbytes"], f["tm_ns"], f["pti"], f["evtnum"], f["v0"], f["v1"], f["ucount"], f["payload"], raw, stream))
        seqs[source], offsets[source] = seq + 1, at + len(raw)
    return spark.createDataFrame(rows, ",".join(f"{c.name} {c.dataType.simpleString()}" for c in FRAME_SCHEMA if c.name != "stream_name") + ", stream_name string")


CONFIG = "stream_name string, group_interval string, unit string, phys_min double, phys_max double, deadband double"
