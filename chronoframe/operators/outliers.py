"""Implausible readings, judged by each stream's own behaviour.

Distinct readings of a stream and UTC day are looked at in order of time. The local course is the median of the
plausible readings before and of those after; the scatter about it comes from mergeable quantile sketches per
stream and hour of day. Flags: impossible values, short spikes outside the expanded interquartile fences, long holds
without variance; and of each whether it was reached at an implausible rate of change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.times import utc_day, whole_div
from chronoframe.operators.arrow import bounds
from chronoframe.schema import DAY_NS, HOUR_NS, SECOND_NS
from chronoframe.session import cut_lineage

SIDE = 7
FENCE = 8.0
MAX_SPIKE = 3
MIN_HOLD, HOLD_TIMES = 12, 4.0
#: Quartiles of the unit normal: ``FENCE`` times the scatter from the middle is so many interquartile ranges beyond a quartile.
QUARTILE = 0.6745
EXPANSION = (FENCE - QUARTILE) / (2 * QUARTILE)
#: Readings of the whole stream that weigh as much as an hour's own in that hour's quartiles.
PRIOR_READINGS = 200
SKETCH_ACCURACY = 2000
CODE_UNIT = "code"
BLOCK = 200_000
#: Distinct readings kept before and after what is being judged: the medians' reach and that of the longest spike.
MARGIN = SIDE + MAX_SPIKE + 1

_PASS1 = "stream_name string, hour int, off double, rate double, n long, holds long"
_PASS2 = "source_id string, seq long, impossible boolean, spike boolean, stuck boolean, steep boolean"
_REASONS = ("impossible", "spike", "stuck", "steep")


def _readings(frames: DataFrame, config: DataFrame) -> DataFrame:
    limits = config.groupBy("stream_name").agg(*(F.max(c).alias(c) for c in ("unit", "phys_min", "phys_max", "deadband")))
    bad = (F.abs("v0") == float("inf")) | F.coalesce(F.col("v0") < F.col("phys_min"), F.lit(False)) | F.coalesce(F.col("v0") > F.col("phys_max"), F.lit(False))
    return (
        frames.where("v0 is not null and not isnan(v0) and tm_ns is not null and raw is not null")
        .select("source_id", "seq", "stream_name", utc_day(F.col("tm_ns")).alias("day"), "tm_ns", "v0", "raw")
        .join(limits, "stream_name", "left")
        .select("source_id", "seq", "stream_name", "day", "tm_ns", "v0", "raw", bad.alias("bad"), F.coalesce("deadband", F.lit(-1.0)).alias("deadband"), F.coalesce(F.col("unit") != CODE_UNIT, F.lit(True)).alias("plain"))
    )


def _in_order(readings: DataFrame) -> DataFrame:
    """Each stream's UTC day in one partition, in order of time; equal readings are neighbours."""
    readings = readings.withColumn("place", F.xxhash64("stream_name", "day"))  # equal readings follow each other, whoever stored them
    return readings.repartition("place").sortWithinPartitions("place", "stream_name", "day", "tm_ns", "raw").drop("place")


def local_course(v: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each value from the median of up to ``side`` values before and after it (NaN where there are none)."""
    n = len(v)
    pad = np.full(side, np.nan)
    windows = sliding_window_view(np.concatenate([pad, v, pad]), side)

    def off(w: np.ndarray, edge: slice) -> np.ndarray:
        out = np.empty(n)
        inner = np.ones(n, dtype=bool)
        inner[edge] = False
        out[inner] = np.partition(w[inner], side // 2, axis=1)[:, side // 2]
        for i in np.flatnonzero(~inner):
            have = w[i][~np.isnan(w[i])]
            out[i] = np.median(have) if len(have) else np.nan
        return v - out

    return off(windows[:n], slice(0, side)), off(windows[side + 1 :], slice(max(0, n - side), n))


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], places: bool):
    """(head row, arrays of the distinct readings, first block of the day, last block of the day): a stream's day in
    blocks of about ``BLOCK`` rows, so that no day has to fit in memory. With ``places``, ``copies`` lists where each is
    stored; a block ends before its last reading, of which more copies may follow."""
    ident, parts, held, started, last_raw = None, [], 0, False, None

    def merged() -> dict:
        return {c: np.concatenate([p[c] for p in parts]) if c not in ("raw", "copies") else [x for p in parts for x in p[c]] for c in parts[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = bounds(batch, ["stream_name", "day"])
        raw = batch.column("raw").to_pylist()
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns if c != "raw"}
        where = list(zip(batch.column("source_id").to_pylist(), batch.column("seq").to_pylist())) if places else None
        names = batch.column("stream_name").take(pa.array(edges[:-1], pa.int64())).to_pylist()
        days = batch.column("day").take(pa.array(edges[:-1], pa.int64())).to_pylist()
        repeat = pc.equal(batch.column("raw").slice(1), batch.column("raw").slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        for s, e, name, day in zip(edges, edges[1:], names, days):
            if (name, day) != ident:
                if ident is not None:
                    yield ident, merged(), not started, True
                ident, parts, held, started, last_raw = (name, day), [], 0, False, None
            keep = np.ones(e - s, dtype=bool)
            keep[1:] = ~repeat[s : e - 1].astype(bool)
            keep[0] = raw[s] != last_raw
            last_raw = raw[e - 1]
            part = {c: x[s:e][keep] for c, x in cols.items()}
            part["raw"] = [x for x, k in zip(raw[s:e], keep.tolist()) if k]
            if places:
                part["copies"] = []
                for at, k in zip(where[s:e], keep.tolist()):
                    if k:
                        part["copies"].append([at])
                    else:
                        (part["copies"] or parts[-1]["copies"])[-1].append(at)
            if not part["raw"]:
                continue
            parts.append(part)
            held += len(part["raw"])
            if held >= BLOCK:
                data = merged()
                yield ident, {c: x[:-1] for c, x in data.items()}, not started, False
                parts, held, started = [{c: x[-1:] for c, x in data.items()}], 1, True
    if ident is not None:
        yield ident, merged(), not started, True


def _with_margin(batches: Iterator[pa.RecordBatch], columns: list[str], places: bool = False):
    """Blocks of the plausible readings with margins: (name, arrays, course before, course after, rows to judge, whole
    block with its breaks). Also yields what the hold state needs: the value before the block."""
    tail, previous = None, None
    for (name, _), data, first, last in _groups(batches, columns, places):
        if first:
            tail, previous = None, None
        v, bad = data["v0"], data["bad"].astype(bool)
        with np.errstate(invalid="ignore"):
            step = np.abs(np.diff(v, prepend=np.nan if previous is None else previous))
            breaks = ~(step <= data["deadband"])
        if len(v):
            previous = v[-1]
        lists = ("raw", "copies")
        ok = {c: (x[~bad] if c not in lists else [r for r, b in zip(x, bad.tolist()) if not b]) for c, x in data.items()}
        ok["done"] = np.zeros(len(ok["v0"]), dtype=bool)
        if tail is not None:
            ok = {c: np.concatenate([tail[c], x]) if c not in lists else tail[c] + x for c, x in ok.items()}
        before, after = local_course(ok["v0"])
        ok["rate"] = np.abs(np.diff(ok["v0"], prepend=np.nan)) / np.maximum(np.diff(ok["tm_ns"], prepend=0), 8) * SECOND_NS
        upto = len(ok["v0"]) if last else max(0, len(ok["v0"]) - MARGIN)
        judge = ~ok["done"]
        judge[upto:] = False
        yield name, data, breaks, first, last, ok, before, after, judge
        ok["done"] = ok["done"] | judge
        start = max(0, upto - 2 * MARGIN)
        tail = {c: x[start:] for c, x in ok.items()}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: distances from the course and rates of change with their hour, and per block the readings and holds."""
    schema = ["stream_name", "hour", "off", "rate", "n", "holds"]
    for name, data, breaks, _, _, ok, before, after, judge in _with_margin(batches, ["tm_ns", "v0", "raw", "bad", "deadband"]):
        b, a = before[judge], after[judge]
        off = (np.where(np.isnan(b), a, b) + np.where(np.isnan(a), b, a)) / 2
        some = ~np.isnan(off)
        hour = (ok["tm_ns"][judge][some] % DAY_NS) // HOUR_NS
        rate = ok["rate"][judge][some]
        k = int(some.sum())
        totals = np.append(np.zeros(k, bool), True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (k + 1), pa.string()),
                pa.array(np.append(hour, 0), pa.int32()),
                pa.array(np.append(off[some], np.nan), pa.float64(), mask=totals),
                pa.array(np.append(rate, np.nan), pa.float64(), mask=totals | np.isnan(np.append(rate, np.nan))),
                pa.array(np.append(np.zeros(k, np.int64), len(breaks)), pa.int64()),
                pa.array(np.append(np.zeros(k, np.int64), int(breaks.sum())), pa.int64()),
            ],
            schema,
        )


def usual(readings: DataFrame) -> DataFrame:
    """Per stream and hour of day (``whole`` = 0) and per stream (``whole`` = 1): the quartiles ``q`` of the distance from
    the local course and ``r`` of the rate of change, from quantile sketches that merge across partitions, the readings
    ``k`` and ``mean_hold``."""
    q, r = (F.percentile_approx(c, [0.25, 0.75], SKETCH_ACCURACY) for c in ("off", "rate"))
    stats = _in_order(readings.drop("source_id", "seq")).mapInArrow(_stats, _PASS1)
    return stats.groupingSets([["stream_name", "hour"], ["stream_name"]], "stream_name", "hour").agg(
        q.alias("q"), r.alias("r"), F.count("off").alias("k"), F.grouping("hour").alias("whole"), F.try_divide(F.sum("n"), F.sum("holds")).alias("mean_hold")
    )


def _fences(table: DataFrame) -> DataFrame:
    """Per stream and hour of day: ``low`` and ``high`` fences about the course, ``swift`` for the rate of change, and
    ``mean_hold``. An hour's quartiles are weighed with its stream's, by its readings; where an hour has no scatter the
    stream's counts alone."""
    s = F.coalesce("stream_name", F.lit("\x01"))
    own = table.where("whole = 1").select(s.alias("s"), F.col("q").alias("own_q"), F.col("r").alias("own_r"), "mean_hold")
    hours = table.where("whole = 0").select(s.alias("s"), F.col("hour").alias("h"), "q", "r", "k").join(own, "s")
    w = F.when(F.element_at("q", 2) > F.element_at("q", 1), F.col("k") / (F.col("k") + PRIOR_READINGS)).otherwise(0.0)
    mixed = lambda c, i: w * F.coalesce(F.element_at(c, i), F.element_at(f"own_{c}", i)) + (1 - w) * F.element_at(f"own_{c}", i)
    m = hours.select("s", "h", "mean_hold", *(mixed(c, i).alias(f"{c}{i}") for c in ("q", "r") for i in (1, 2)))
    reach = EXPANSION * (F.col("q2") - F.col("q1"))
    return m.select("s", "h", "mean_hold", (F.col("q1") - reach).alias("low"), (F.col("q2") + reach).alias("high"), (F.col("r2") + EXPANSION * (F.col("r2") - F.col("r1"))).alias("swift"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["tm_ns", "v0", "raw", "bad", "deadband", "plain", "low", "high", "swift", "mean_hold"]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 6
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), *[pa.bool_()] * 4])], ["source_id", "seq", *_REASONS])
        out.clear()
        return batch

    def add(copies: list, *reasons: bool) -> None:
        out.extend((*at, *reasons) for at in copies)

    waiting: list[list] = []  # readings of the open hold, as long as it is short
    length = 0
    for _, data, breaks, first, last, ok, before, after, judge in _with_margin(batches, columns, True):
        for i in np.flatnonzero(data["bad"]):
            add(data["copies"][i], True, False, False, False)
        if len(ok["v0"]) and ok["plain"][0]:
            b = np.where(np.isnan(before), after, before)
            a = np.where(np.isnan(after), before, after)
            low, high = ok["low"], ok["high"]
            with np.errstate(invalid="ignore"):
                wide = np.where(np.abs(b) >= np.abs(a), b, a)
                side = np.where(high > low, np.where(wide > high, 1, np.where(wide < low, -1, 0)), 0)
                both = (side != 0) & ((np.minimum(a, b) > high) | (np.maximum(a, b) < low))
                steep = ok["rate"] > ok["swift"]
            turn = np.flatnonzero(np.diff(side, prepend=np.nan) != 0)
            stretch = np.repeat(np.diff(np.append(turn, len(side))), np.diff(np.append(turn, len(side))))
            for i in np.flatnonzero(both & judge & (stretch <= MAX_SPIKE)):
                add(ok["copies"][i], False, True, False, bool(steep[i]))
        if first:
            waiting, length = [], 0
        if len(breaks) and data["plain"][0]:
            most = max(float(MIN_HOLD) - 0.5, HOLD_TIMES * float(data["mean_hold"][0]))
            starts = np.flatnonzero(breaks)
            edges = [0, *starts[starts > 0].tolist(), len(breaks)]
            for j, (s, e) in enumerate(zip(edges, edges[1:])):
                if j or breaks[0]:
                    waiting, length = [], 0
                was, length = length, length + e - s
                if length > most:
                    for copies in (*(waiting if was <= most else ()), *data["copies"][s:e]):
                        add(copies, False, False, True, False)
                    waiting = []
                elif j == len(edges) - 2 and not last:
                    waiting.extend(data["copies"][s:e])
        if len(out) > 5000:
            yield flush()
    yield flush()


def implausible(frames: DataFrame, config: DataFrame) -> DataFrame:
    """Every stored copy of a faulty reading: source_id, seq and the reasons ``impossible``, ``spike``, ``stuck``; ``steep``
    says whether a spike was reached at a rate of change outside the stream's fence (alone it is no fault).

    A reading is a frame with v0 neither null nor NaN, a tm_ns and raw; distinct readings (by raw) of a stream and UTC
    day are looked at in order of time. Impossible: infinite or outside the configured limits. Spike: at most
    ``MAX_SPIKE`` readings on end that lie outside the expanded interquartile fences about the course before and after, on
    the same side; where neighbours still lie off on one side the excursion is longer than it looks and no spike. Stuck:
    a hold (each value within the deadband of the one before) of at least ``MIN_HOLD`` readings and more than
    ``HOLD_TIMES`` the stream's mean hold. Streams of unit ``code`` are only checked for impossible values. Streams
    without configuration have no limits and no deadband, so only spikes. The fences are those of the stream and hour of
    day; without scatter in both they are ``FENCE`` deadbands wide, and without a deadband there are no spikes. Ties of tm_ns
    are ordered by raw; an empty input gives no rows; repeated rows are copies.

    Two passes over the readings, each one shuffle by stream and day and then a stream of blocks: a day of any size
    needs ``BLOCK`` readings of memory. The statistics joined in between have one row per stream and hour. Copies lie
    next to each other in order of time, so nothing is joined back."""
    readings = _readings(frames, config)
    known = _fences(cut_lineage(usual(readings)))
    hour = whole_div(F.pmod("tm_ns", F.lit(DAY_NS)), HOUR_NS).cast("int")
    judged = readings.join(known, (F.coalesce("stream_name", F.lit("\x01")) == F.col("s")) & (hour == F.col("h")), "left").drop("s", "h")
    flat = F.coalesce(F.col("high") <= F.col("low"), F.lit(True))
    band = F.lit(FENCE) * F.greatest("deadband", F.lit(0.0))
    judged = judged.withColumns({"low": F.when(flat, -band).otherwise(F.col("low")), "high": F.when(flat, band).otherwise(F.col("high")), "swift": F.coalesce("swift", F.lit(float("inf"))), "mean_hold": F.coalesce("mean_hold", F.lit(float("inf")))})
    return _in_order(judged).mapInArrow(_judge, _PASS2).groupBy("source_id", "seq").agg(*(F.max(c).alias(c) for c in _REASONS))
