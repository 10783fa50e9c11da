"""Seeded frame tables for tests and demonstrations, built from `spark.range`, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.frames import to_frames
from chronoframe.functions.text import schema_to_msgpack
from chronoframe.schema import SECOND_NS

START_NS = 1455580800000000000  # 2016-02-16T00:00:00Z


def _each_second(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id"), (F.lit(START_NS) + F.col("id") * SECOND_NS).alias("tm"))


def mixed(spark: SparkSession, n: int, seed: int = 1, source: str = "mixed") -> DataFrame:
    """One frame a second, in turn: a payload of 0 to 253 rising bytes, a Zero, both numbers equal to the place."""
    size = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(254)).cast("int")
    rising = F.unhex(F.substring(F.lit("".join(f"{k:02x}" for k in range(254))), F.lit(1), size * 2))
    kind = F.col("id") % 3
    d = _each_second(spark, n).select(
        "id", "tm", F.when(kind == 0, 15).when(kind == 1, 0).otherwise(3).alias("e"), F.col("id").cast("double").alias("a"),
        F.when(kind == 0, rising).alias("p"), F.lit(source).alias("s"),
    )
    return to_frames(d, "tm", "e", "a", "id", "p", "s", "id")


def floats(spark: SparkSession, n: int, source: str = "floats") -> DataFrame:
    """One float frame a second with the values 0 to n - 1."""
    d = _each_second(spark, n).select("*", F.lit(2).alias("e"), F.col("id").cast("double").alias("a"), F.lit(source).alias("s"))
    return to_frames(d, "tm", "e", "a", source="s", seq="id")


def pairs(spark: SparkSession, n: int, source: str = "pairs") -> DataFrame:
    """One frame a second with the place as float and 0 as integer."""
    d = _each_second(spark, n).select("*", F.lit(3).alias("e"), F.col("id").cast("double").alias("a"), F.lit(0).alias("b"), F.lit(source).alias("s"))
    return to_frames(d, "tm", "e", "a", "b", source="s", seq="id")


def repeats(spark: SparkSession, reps: list[int], source: str = "repeats") -> DataFrame:
    """Second i has ``reps[i]`` float frames of the value i."""
    rows = [(i, START_NS + i * SECOND_NS, 2, float(i)) for i, n in enumerate(reps) for _ in range(n)]
    d = spark.createDataFrame([(k, *r[1:], source) for k, r in enumerate(rows)], "id long, tm long, e int, a double, s string")
    return to_frames(d, "tm", "e", "a", source="s", seq="id")


def gapped(spark: SparkSession, start_ns: int, deltas: list[float], kinds: list[int], seconds: list[int], source: str = "gapped") -> DataFrame:
    """Both-number frames (delta, kind) at the given seconds; deltas of 0 are skipped."""
    rows = [(start_ns + s * SECOND_NS, 3, float(d), k) for d, k, s in zip(deltas, kinds, seconds) if d != 0]
    d = spark.createDataFrame([(i, *r, source) for i, r in enumerate(rows)], "id long, tm long, e int, a double, b long, s string")
    return to_frames(d, "tm", "e", "a", "b", source="s", seq="id")


def log_entries(spark: SparkSession, n: int, source: str = "log") -> DataFrame:
    """One log entry a second, encoded by field number: lsn (left out when 0) and op, the place in hexadecimal."""
    entry = F.to_json(F.struct(F.when(F.col("id") > 0, F.col("id")).alias("0"), F.concat(F.lit("0x"), F.lower(F.hex("id"))).alias("1")))
    d = _each_second(spark, n).select("*", F.lit(16).alias("e"), schema_to_msgpack(entry, F.lit("LogEntry")).alias("p"), F.lit(source).alias("s"))
    return to_frames(d, "tm", "e", payload="p", source="s", seq="id")
