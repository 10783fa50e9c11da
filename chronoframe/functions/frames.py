"""Column expressions over the frame envelope, and building frames from columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe import codec, vectors
from chronoframe.schema import EVTNUM_MAX, EVTNUM_MIN, FRAME_SCHEMA, MAX_PAYLOAD, PTI_UDE

# The printed names of the event numbers.
EVTNUM_NAMES = {
    -1: "EvErr", 0: "EvZero", 1: "EvOneInt64", 2: "EvOneFloat64", 3: "EvTwo64", 4: "EvNull", 5: "EvNA", 6: "EvNaN", 7: "EvUDE",
    8: "EvHeader", 9: "EvMsgpack", 10: "EvBinc", 11: "EvCapnp", 12: "EvZygo", 13: "EvUtf8", 14: "EvJson", 15: "EvMsgpKafka",
}


def prim_time(tm: Column) -> Column:
    """Time as a frame stores it: floored to 8 ns."""
    return tm.bitwiseAND(F.lit(-8).cast("long"))


def prim(tm: Column, pti: Column) -> Column:
    return prim_time(tm).bitwiseOR(pti.cast("long"))


def pti_of(evtnum: Column) -> Column:
    return F.when(evtnum.between(0, PTI_UDE - 1), evtnum).otherwise(PTI_UDE).cast("tinyint")


def wire_size(pti: Column, ucount: Column) -> Column:
    """Bytes of a frame."""
    return F.when(pti.isin(0, 4, 5, 6), F.lit(8)).when(pti.isin(1, 2), F.lit(16)).when(pti == 3, F.lit(24)).otherwise(F.coalesce(ucount, F.lit(0)) + 16).cast("int")


def get_v0(pti: Column, v0: Column) -> Column:
    """The value as a number: 0 for Zero and integer frames, v0 where there is one, else NaN."""
    return F.when(pti.isin(0, 1), 0.0).when(pti.isin(2, 3), v0).otherwise(float("nan"))


def get_v1(pti: Column, v1: Column) -> Column:
    """v1 of frames that carry both numbers, else 0."""
    return F.when(pti == 3, v1).otherwise(F.lit(0).cast("long"))


def set_v1(frames: DataFrame, v1: Column) -> DataFrame:
    """Frames with another v1 where they carry both numbers; the others stay as they are. ``raw`` follows."""
    changed = frames.withColumn("v1", F.when(F.col("pti") == 3, v1.cast("long")).otherwise(F.col("v1")))
    return changed.withColumn("raw", F.when(F.col("pti") == 3, encode_raw("tm_ns", "evtnum", "v0", "v1", "payload")).otherwise(F.col("raw")))


def get_bool(pti: Column) -> Column:
    """Boolean streams write false as Zero and true as Null, by convention."""
    return F.when(pti == 0, False).when(pti == 4, True)


def valid_evtnum(evtnum: Column) -> Column:
    return evtnum.between(EVTNUM_MIN, EVTNUM_MAX)


def evtnum_name(evtnum: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in EVTNUM_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, evtnum), F.concat(F.lit("Ev."), evtnum.cast("string")))


def set_time(frames: DataFrame, tm: Column) -> DataFrame:
    """Frames with another time and the same payload; ``raw`` follows."""
    moved = frames.withColumn("tm_ns", prim_time(tm))
    return moved.withColumn("raw", encode_raw("tm_ns", "evtnum", "v0", "v1", "payload"))


@F.arrow_udf(T.BinaryType())
def encode_raw(tm: pa.Array, evtnum: pa.Array, v0: pa.Array, v1: pa.Array, payload: pa.Array) -> pa.Array:
    """Wire bytes from columns; null numbers are written as 0, NaN stays NaN."""
    return vectors.encode(tm, evtnum, v0, v1, payload)


@F.arrow_udf(T.LongType())
def checksum64(raw: pa.Array) -> pa.Array:
    """The first eight bytes of the frame's BLAKE2b-512 as a number."""
    return pa.array([None if r is None else codec.checksum64(r) for r in raw.to_pylist()], pa.int64())


@F.arrow_udf(T.BinaryType())
def blake2b(raw: pa.Array) -> pa.Array:
    return pa.array([None if r is None else codec.blake2b(r) for r in raw.to_pylist()], pa.binary())


_DECODED = T.StructType([f for f in FRAME_SCHEMA if f.name not in ("source_id", "seq", "byte_offset")])


@F.arrow_udf(_DECODED)
def decode_raw(raw: pa.Array) -> pa.Array:
    """Columns of the frame in each BINARY value; all null for null."""
    names = _DECODED.fieldNames()
    cols = vectors.decode_values(raw, names)
    return pa.StructArray.from_arrays([cols[c] for c in names], names)


def _checked(bad: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(message)).cast("int")).otherwise(value)


def to_frames(df: DataFrame, tm: str, evtnum: str, v0: str | None = None, v1: str | None = None, payload: str | None = None, source: str | None = None, seq: str | None = None) -> DataFrame:
    """Frames from columns. Errors: an EVTNUM out of range or null, a payload given for EVTNUM 0 to 6, a payload too
    long. Numbers the type does not carry are dropped; an empty payload is none. ``seq`` must be dense per source."""
    none = lambda t: F.lit(None).cast(t)
    e = F.col(evtnum).cast("int")
    data = F.col(payload).cast("binary") if payload else none("binary")
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    e = _checked(~valid_evtnum(e) | e.isNull(), "EVTNUM out of range", e)
    e = F.when((size > 0) & F.col(evtnum).between(0, PTI_UDE - 1), F.raise_error(F.lit("no payload allowed for EVTNUM 0 to 6")).cast("int")).when(size > MAX_PAYLOAD, F.raise_error(F.lit("payload too long")).cast("int")).otherwise(e)
    d = df.select(
        (F.col(source) if source else F.lit("")).alias("source_id"),
        (F.col(seq).cast("long") if seq else none("long")).alias("seq"),
        prim_time(F.col(tm).cast("long")).alias("tm_ns"),
        e.alias("evtnum"),
        (F.col(v0).cast("double") if v0 else none("double")).alias("a"),
        (F.col(v1).cast("long") if v1 else none("long")).alias("b"),
        F.when(size > 0, data).alias("payload"),
    )
    d = d.withColumn("pti", pti_of(F.col("evtnum")))
    d = d.withColumn("ucount", F.when((F.col("pti") == PTI_UDE) & F.col("payload").isNotNull(), F.octet_length("payload") + 1).otherwise(0).cast("long"))
    zero = F.coalesce("a", F.lit(0.0))
    d = d.withColumn("v0", F.when(F.col("pti").isin(2, 3), zero)).withColumn("v1", F.when(F.col("pti").isin(1, 3), F.coalesce("b", F.lit(0).cast("long"))))
    d = d.withColumn("nbytes", wire_size(F.col("pti"), F.col("ucount"))).withColumn("raw", encode_raw("tm_ns", "evtnum", "v0", "v1", "payload"))
    return d.select("source_id", "seq", F.lit(None).cast("long").alias("byte_offset"), "nbytes", "tm_ns", "pti", "evtnum", "v0", "v1", "ucount", "payload", "raw")


def to_msgpack_frames(df: DataFrame, tm: str, columns: list[str], source: str | None = None, seq: str | None = None) -> DataFrame:
    """Frames whose payload is the msgpack of the given columns."""
    from chronoframe.functions.text import json_to_msgpack

    d = df.withColumn("_payload", json_to_msgpack(F.to_json(F.struct(*columns)))).withColumn("_evtnum", F.lit(9))
    return to_frames(d, tm, "_evtnum", payload="_payload", source=source, seq=seq)
