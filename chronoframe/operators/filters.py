"""Regex filters over the text of frames, group extraction, field search in text lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.text import stringify


def _hits(text: Column, patterns: list[str]) -> list[Column]:
    """An empty match is none."""
    return [F.coalesce(F.regexp_extract(text, p, 0) != "", F.lit(False)) for p in patterns]


def regex_condition(text: Column, patterns: list[str], match_any: bool = False, exclude: bool = False) -> Column:
    """All patterns match, or any; ``exclude`` turns the answer round. A null text matches nothing."""
    if not patterns:
        raise ValueError("no pattern")
    c = reduce((lambda a, b: a | b) if match_any else (lambda a, b: a & b), _hits(text, patterns))
    return ~c if exclude else c


def filter_regex(frames: DataFrame, patterns: list[str], match_any: bool = False, exclude: bool = False, text: Column | None = None) -> DataFrame:
    """The frames whose printed line (or ``text``) fulfils the condition. One stage, no shuffle."""
    if not patterns:
        raise ValueError("no pattern")
    marked = frames.withColumn("_text", text if text is not None else stringify())
    return marked.where(regex_condition(F.col("_text"), patterns, match_any, exclude)).drop("_text")


def extract_groups(df: DataFrame, text: Column, pattern: str, groups: int, name: str = "sub") -> DataFrame:
    """The capture groups of the first match, joined by one space; only rows that match."""
    return df.where(text.rlike(pattern)).withColumn(name, F.concat_ws(" ", *(F.regexp_extract(text, pattern, k) for k in range(1, groups + 1))))


def filter_sub(frames: DataFrame, patterns: list[str], match_any: bool = False, exclude: bool = False, text: Column | None = None, name: str = "sub") -> DataFrame:
    """The frames that fulfil the condition, with the capture groups of the pattern that was tested last, joined by one
    space, as ``sub``. Patterns are tested in order until the answer is known; an empty match counts as one here. Where the
    last one tested does not match, or has no groups, there is nothing to print and the frame has no row."""
    if not patterns:
        raise ValueError("no pattern")
    line = F.col("_text")
    marked = frames.withColumn("_text", text if text is not None else stringify())
    hits = [F.coalesce(line.rlike(p), F.lit(False)) for p in patterns]
    groups = [re.compile(p).groups for p in patterns]
    parts = [F.concat_ws(" ", *(F.regexp_extract(line, p, k) for k in range(1, g + 1))) if g else F.lit(None).cast("string") for p, g in zip(patterns, groups)]
    # any: the first hit decides; all: the first miss does; else the last pattern was tested
    last = F.when(hits[-1], parts[-1])
    if match_any:
        for h, p in zip(hits[-2::-1], parts[-2::-1]):
            last = F.when(h, p).otherwise(last)
    else:
        for h in hits[-2::-1]:
            last = F.when(h, last)
    c = reduce((lambda a, b: a | b) if match_any else (lambda a, b: a & b), hits)
    return marked.where(~c if exclude else c).withColumn(name, last).where(F.col(name).isNotNull()).drop("_text")


def grep_fields(lines: DataFrame, *fields: str, line: str = "value") -> DataFrame:
    """The values of JSON fields in text lines, one a row (``field``, ``found``), as written: first the escaped form
    of strings inside strings, then the plain one up to the next comma or brace. The first match of each counts; field
    names are patterns. Other columns of ``lines`` stay."""
    forms = []
    for f in fields:
        forms += [(f, rf"\\\"{f}\\\":\\\"([^\\]+)\\\""), (f, rf'"{f}":([^,}}]+)[,}}]')]
    found = [F.when(F.col(line).rlike(p), F.struct(F.lit(f).alias("field"), F.lit(i).alias("_k"), F.regexp_extract(line, p, 1).alias("found"))) for i, (f, p) in enumerate(forms)]
    out = lines.withColumn("_hit", F.explode(F.array_compact(F.array(*found))))
    return out.select(*lines.columns, "_hit.field", "_hit.found")
