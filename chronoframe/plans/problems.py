"""The data problems of the core: pN_... queries over the whole archive tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators.compaction import PACK_BYTES, fold_frames, folded_files, packs
from chronoframe.operators.outliers import implausible
from chronoframe.operators.regular_grid import empty_periods, held_out_errors, regular_grid
from chronoframe.operators.shredding import all_entities, child_objects, entities
from chronoframe.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files to fold into their stream's day, as they were joined into its packs."""
    return folded_files(fold_frames(table(spark, d, "frames"), table(spark, d, "archive_files")))


def p1_packs(spark: SparkSession, d: str) -> DataFrame:
    """The packs that hold every distinct frame once: frames and bytes of each."""
    return packs(fold_frames(table(spark, d, "frames"), table(spark, d, "archive_files"))).drop("path", "crc32")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods without a reading."""
    return empty_periods(regular_grid(table(spark, d, "frames"), table(spark, d, "stream_config")))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular series: observed, filled and unsupported periods."""
    return regular_grid(table(spark, d, "frames"), table(spark, d, "stream_config"))


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    """How far fills lie from hidden readings, per stream, beside the day's mean and median."""
    return held_out_errors(table(spark, d, "frames"), table(spark, d, "stream_config"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return all_entities(table(spark, d, "frames"), table(spark, d, "evtnum_registry"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Objects below the roots of nested payloads, with the object that encloses each."""
    return child_objects(_entities(spark, d))


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """Entity table of the outermost spans of a log entry."""
    return entities(_entities(spark, d), "/spans/*", ["id", "name"])


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """An entity row for every object of every path, with its scalar members."""
    return _entities(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every stored copy of a faulty reading."""
    return implausible(table(spark, d, "frames"), table(spark, d, "stream_config")).select("source_id", "seq")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Faulty readings per stream and reason."""
    frames = table(spark, d, "frames").select("source_id", "seq", "stream_name")
    faults = implausible(table(spark, d, "frames"), table(spark, d, "stream_config"))
    counts = (F.count_if(c).alias(f"n_{c}") for c in ("impossible", "spike", "stuck", "steep"))
    return faults.join(frames, ["source_id", "seq"]).groupBy("stream_name").agg(F.count("*").alias("n_faulty"), *counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_packs, p2_found, p2_grid, p2_errors, p3_found, p3_spans, p3_entities, p4_found, p4_reasons)
}

_READ = "v0 IS NOT NULL AND NOT isnan(v0)"

SQL: dict[str, str] = {
    "p1_found": """
WITH f AS (SELECT source_id, stream_name, tm_ns // 86400000000000 AS day, nbytes, raw FROM frames),
s AS (SELECT source_id, stream_name, day, sum(nbytes) AS b, count(DISTINCT raw) AS k FROM f GROUP BY ALL),
m AS (SELECT s.*, a.file_id, count(*) OVER (PARTITION BY s.stream_name, s.day) AS n FROM s JOIN archive_files a ON a.path = s.source_id),
u AS (SELECT DISTINCT source_id, stream_name, day, raw FROM f),
c AS (SELECT x.source_id AS a, y.source_id AS b, x.stream_name, x.day, count(*) AS k
      FROM u x JOIN u y ON x.stream_name = y.stream_name AND x.day = y.day AND x.raw = y.raw AND x.source_id <> y.source_id GROUP BY ALL),
covered AS (SELECT DISTINCT ma.source_id FROM c JOIN m ma ON ma.source_id = c.a JOIN m mb ON mb.source_id = c.b
            WHERE c.k = ma.k AND (mb.k > ma.k OR mb.k = ma.k AND mb.file_id < ma.file_id))
SELECT file_id, stream_name, strftime(make_date(1970, 1, 1) + CAST(day AS INTEGER), '%Y/%m/%d') AS file_day
FROM m WHERE b < 16384 AND n >= 2 AND source_id NOT IN (SELECT source_id FROM covered)""",
    "p1_packs": f"""
WITH u AS (SELECT stream_name, tm_ns // 86400000000000 AS day, tm_ns, raw, min(nbytes) AS nbytes FROM frames GROUP BY ALL),
s AS (SELECT *, sum(nbytes) OVER (PARTITION BY stream_name, day ORDER BY tm_ns, raw ROWS UNBOUNDED PRECEDING) - nbytes AS start FROM u)
SELECT stream_name, strftime(make_date(1970, 1, 1) + CAST(day AS INTEGER), '%Y/%m/%d') AS file_day, CAST(start // {PACK_BYTES} AS BIGINT) AS pack,
count(*) AS n_frames, CAST(sum(nbytes) AS BIGINT) AS n_bytes FROM s GROUP BY ALL""",
    "p2_found": f"""
WITH c AS (SELECT stream_name, CASE WHEN trim(coalesce(group_interval, '')) = '' THEN 60000000000 ELSE CAST(round(
  CASE WHEN n = '' THEN 1.0 WHEN n LIKE '%/%' THEN CAST(split_part(n, '/', 1) AS DOUBLE) / CAST(split_part(n, '/', 2) AS DOUBLE) ELSE CAST(n AS DOUBLE) END
  * CASE lower(u[1]) WHEN 's' THEN 1e9 WHEN 'm' THEN 6e10 ELSE 3.6e12 END) AS BIGINT) END AS i
  FROM (SELECT *, regexp_extract(group_interval, '^\\s*([0-9./]*)', 1) AS n, regexp_extract(group_interval, '([A-Za-z]+)', 1) AS u FROM stream_config)),
r AS (SELECT DISTINCT f.stream_name, tm_ns // 86400000000000 AS day, i, tm_ns // i AS k FROM frames f JOIN c USING (stream_name) WHERE {_READ}),
g AS (SELECT *, lead(k) OVER (PARTITION BY stream_name, day ORDER BY k) AS nxt FROM r)
SELECT stream_name, unnest(range(k + 1, nxt)) * i AS period_start_ns FROM g WHERE nxt > k + 1""",
}
