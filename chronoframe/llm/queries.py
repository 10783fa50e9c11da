"""Queries over the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.times import day_text, utc_day
from chronoframe.llm.digests import certified_percentiles
from chronoframe.llm.leakage import leaked_items, leaked_spans, removal_spans
from chronoframe.llm.runs import collapse_runs
from chronoframe.llm.tokens import decode_ids, encode_corpus
from chronoframe.llm.truncation import truncated, truncation_rates
from chronoframe.plans.tables import table


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frames").select("stream_name", utc_day(F.col("tm_ns")).alias("day"), "v0")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per stream and day, each with its certified rank error."""
    out = certified_percentiles(_values(spark, d), "v0", ["stream_name", "day"])
    return out.withColumn("file_day", day_text(F.col("day"))).drop("day")


def p5_stream_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per stream over all days, from the merged digests of the days, each with its certified rank error."""
    return certified_percentiles(_values(spark, d), "v0", ["stream_name"], parts=["day"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three or more like frames."""
    return collapse_runs(table(spark, d, "frames"), table(spark, d, "stream_config"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Documents decoded from their ids again."""
    return decode_ids(encode_corpus(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they leak."""
    return leaked_items(leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Merged spans of leaked words, to be removed."""
    spans = removal_spans(leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")))
    return spans.select("doc_id", "first_word", "last_word", F.size("items").alias("n_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Cut documents."""
    return truncated(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts, and at which limit."""
    return truncation_rates(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p5_percentiles, p5_stream_percentiles, p6_found, p7_ids, p7_decoded, p8_found, p8_spans, p9_found, p9_rates)
}

SQL: dict[str, str] = {
    "p6_found": """
WITH e AS (SELECT DISTINCT stream_name, tm_ns // 86400000000000 AS day, tm_ns, pti, v0, raw FROM frames WHERE pti BETWEEN 0 AND 6),
l AS (SELECT e.*, deadband, lag(pti) OVER w AS lp, lag(v0) OVER w AS lv FROM e LEFT JOIN stream_config USING (stream_name)
      WINDOW w AS (PARTITION BY stream_name, day ORDER BY tm_ns, raw)),
s AS (SELECT *, sum(CASE WHEN coalesce(pti = lp AND (pti NOT IN (2, 3) OR (NOT isnan(v0) AND NOT isnan(lv) AND
        (v0 = lv OR coalesce(abs(v0 - lv) <= deadband, false)))), false) THEN 0 ELSE 1 END) OVER (PARTITION BY stream_name, day ORDER BY tm_ns, raw) AS run FROM l)
SELECT stream_name, min(tm_ns) AS start_ns, max(tm_ns) AS end_ns, count(*) AS n_frames FROM s GROUP BY stream_name, day, run HAVING count(*) >= 3""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
