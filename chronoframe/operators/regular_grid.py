"""Irregular readings onto a regular grid, missing periods filled or marked.

Each stream has its own period length. Streams of equal period length form a source-by-time matrix per UTC day; a
low-rank factorisation by alternating least squares fills its missing cells. Observed cells stay exactly as measured,
cells without support stay marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.times import floor_to, utc_day, whole_div
from chronoframe.schema import DAY_NS, HOUR_NS, MINUTE_NS, SECOND_NS

OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"
MATRIX_CELLS = 2_000_000
RANK, RIDGE = 2, 1.0
#: The factorisation goes on until no cell moves by more than this (in units of its source's scatter), or so many rounds.
SETTLED, MOST_ROUNDS = 1e-3, 100
#: Observed cells further than this from their source's median, in units of its scatter, take no part in the fit.
OUTLYING = 8.0
#: Adjacent observed cells a source needs for its departures from the product to count as persistent.
LEAST_PAIRS = 8
#: Columns of a day's matrix; days of finer periods are cut in time.
MATRIX_COLUMNS = 100_000
HASH_BLOCKS = 1024

_NUMBER = r"^[\s]*([0-9]*\.?[0-9]+|[0-9]+\.)?[\s]*(?:/[\s]*([0-9]*\.?[0-9]+))?[\s]*([A-Za-z]*)\.?[\s]*$"


def interval_ns(text: Column, default_ns: int = MINUTE_NS) -> Column:
    """Nanoseconds of ``[number]unit``: the number whole, decimal or a fraction (1 if absent), the unit seconds,
    minutes or hours in any usual spelling and case. Null, blank and unreadable texts and lengths that are not
    positive give ``default_ns``."""
    number, below, unit = (F.regexp_extract(text, _NUMBER, k) for k in (1, 2, 3))
    size = (
        F.when(F.lower(unit).rlike("^s(ec(ond)?s?)?$"), SECOND_NS)
        .when(F.lower(unit).rlike("^m(in(ute)?s?)?$"), MINUTE_NS)
        .when(F.lower(unit).rlike("^h((ou)?rs?)?$"), HOUR_NS)
    )
    n = F.when(number == "", 1.0).otherwise(F.expr("double(0)") + number.try_cast("double"))
    d = F.when(below == "", 1.0).otherwise(below.try_cast("double"))
    ns = F.round(F.try_divide(n * size, d)).cast("long")
    return F.coalesce(F.when(ns > 0, ns), F.lit(default_ns))


def _solve(w: np.ndarray, x: np.ndarray, f: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Ridge-regularised least squares of every row of ``x`` (weights ``w``) on the features ``f``."""
    a = (w @ (f[:, :, None] * f[:, None, :]).reshape(len(f), -1)).reshape(-1, f.shape[1], f.shape[1]) + np.diag(ridge)
    return np.linalg.solve(a, (x @ f)[..., None])[..., 0]


def _als(m: np.ndarray, rank: int) -> np.ndarray:
    """The standardised matrix ``m`` (NaN = missing) as an offset per source plus a product of low rank: every round
    solves all columns given the rows, then all rows and offsets given the columns, until the product settles."""
    w = ~np.isnan(m)
    x = np.where(w, m, 0.0)
    wf = w.astype(float)
    u = np.concatenate([np.ones((len(m), 1)), np.random.default_rng(7).standard_normal((len(m), rank - 1)) * 0.5], axis=1)
    offset = np.zeros((len(m), 1))
    ridge = np.full(rank, RIDGE)
    product = np.zeros(m.shape)
    for _ in range(MOST_ROUNDS):
        v = _solve(wf.T, (x - offset * wf).T, u, ridge)
        rows = _solve(wf, x, np.concatenate([np.ones((len(v), 1)), v], axis=1), np.append(RIDGE / 10, ridge))
        offset, u = rows[:, :1], rows[:, 1:]
        before, product = product, offset + u @ v.T
        if np.abs(product - before).max(initial=0.0) < SETTLED:
            break
    return product


def _bridge(rest: np.ndarray) -> np.ndarray:
    """Expected departures from the product in the missing cells of each row, given those on either side: they fade with
    the distance as fast as the row's adjacent ones lose their likeness (a first-order autoregression); none where that
    cannot be told."""
    n, width = rest.shape
    known = ~np.isnan(rest)
    r = np.where(known, rest, 0.0)
    pairs = known[:, 1:] & known[:, :-1]
    both = np.where(pairs, r[:, 1:] * r[:, :-1], 0.0).sum(axis=1)
    size = np.where(pairs, (r[:, 1:] ** 2 + r[:, :-1] ** 2) / 2, 0.0).sum(axis=1)
    rho = np.where((pairs.sum(axis=1) >= LEAST_PAIRS) & (size > 0), both / np.where(size > 0, size, 1.0), 0.0).clip(0.0, 0.9999)[:, None]
    at = np.arange(width)[None, :]
    left = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(known, at, width)[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(n)[:, None]
    a = np.where(left >= 0, rho ** (at - left), 0.0)
    b = np.where(right < width, rho ** (right - at), 0.0)
    span = 1.0 - (a * b) ** 2
    span = np.where(span > 0, span, 1.0)
    return a * (1 - b**2) / span * r[row, np.maximum(left, 0)] + b * (1 - a**2) / span * r[row, np.minimum(right, width - 1)]


def complete(m: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The source-by-time matrix with its missing cells estimated, and which cells have support: the row must have
    more observed cells than the rank has parameters, the column at least one observed cell in another such row.

    Rows are scaled by median and interquartile range, so that spikes neither set the scale nor, as outlying cells, enter
    the fit; they stay as observed. An estimate is the product plus what is expected to last of the departures from it
    before and after."""
    w = ~np.isnan(m)
    good = w.sum(axis=1) > rank + 1
    support = good[:, None] & (w & good[:, None]).any(axis=0)[None, :]
    filled = m.copy()
    if good.sum() < 2:
        return filled, np.zeros_like(w)
    part = m[good]
    q1, middle, q3 = np.nanpercentile(part, [25, 50, 75], axis=1, keepdims=True)
    scale = (q3 - q1) / 1.349
    std = np.nanstd(part, axis=1, keepdims=True)
    scale = np.where(scale > 0, scale, np.where(std > 0, std, 1.0))
    cols = (~np.isnan(part)).any(axis=0)
    z = (part[:, cols] - middle) / scale
    z[np.abs(z) > OUTLYING] = np.nan
    product = _als(z, min(rank, int(good.sum())))
    guess = np.full(part.shape, np.nan)
    guess[:, cols] = (product + _bridge(z - product)) * scale + middle
    rows = np.flatnonzero(good)
    filled[rows] = np.where(w[rows], m[rows], guess)
    return filled, support & ~w


def _fill(rank: int):
    """A day's matrix of one period length (or a stretch of it): rows are cells with a value, and marks without one that
    say where a stream's day begins and ends."""

    def run(table: pa.Table) -> pa.Table:
        order = table.column("stream_name").combine_chunks().dictionary_encode()
        row = order.indices.fill_null(len(order.dictionary)).to_numpy(zero_copy_only=False)
        col = table.column("k").to_numpy()
        mark = table.column("mark").to_numpy(zero_copy_only=False).astype(bool)
        val = table.column("value").to_numpy().astype(float)
        n = int(row.max()) + 1 if len(row) else 0
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(first, row, col)
        np.maximum.at(last, row, col)
        lo = int(first.min()) if n else 0
        width = int(last.max()) - lo + 1 if n else 0
        row, col, val = row[~mark], col[~mark], val[~mark]
        exact = np.full((n, width), np.nan)
        exact[row, col - lo] = val
        seen = np.zeros((n, width), dtype=bool)
        seen[row, col - lo] = True
        filled, support = complete(np.where(np.isfinite(exact), exact, np.nan), rank)
        r, c = np.nonzero((np.arange(width)[None, :] + lo >= first[:, None]) & (np.arange(width)[None, :] + lo <= last[:, None]))
        was = seen[r, c]
        can = support[r, c] & ~was
        value = np.where(was, exact[r, c], np.where(can, filled[r, c], np.nan))
        length = table.column("interval_ns")[0].as_py() if n else 1
        status = pa.DictionaryArray.from_arrays(pa.array(np.where(was, 0, np.where(can, 1, 2)), pa.int32()), pa.array([OBSERVED, FILLED, UNSUPPORTED])).cast(pa.string())
        names = pa.concat_arrays([order.dictionary, pa.array([None], pa.string())]).take(pa.array(r))
        return pa.table(
            {
                "stream_name": names,
                "period_start_ns": pa.array((c + lo) * length, pa.int64()),
                "interval_ns": pa.array(np.full(len(r), length), pa.int64()),
                "value": pa.array(value, pa.float64(), mask=np.isnan(value)),
                "status": status,
            }
        )

    return run


def regular_grid(frames: DataFrame, config: DataFrame, rank: int = RANK) -> DataFrame:
    """One row per stream and period between the first and last reading of each UTC day: stream_name,
    period_start_ns, interval_ns, value, status.

    A reading is a frame whose v0 is neither null nor NaN (infinite values count). An observed period has the mean of
    its finite readings (null if all are infinite); a missing one the completed matrix' value (``filled``), or null
    where the matrix gives no support (``unsupported``). Streams the configuration does not name have the default
    period. Frames without tm_ns are no readings. Repeated rows change nothing but weights of the mean.

    Readings are averaged per cell before anything is shuffled by day, so a stream with most of the rows sends no more
    than its cells. A day's matrix is cut into blocks of at most ``MATRIX_CELLS`` cells, whatever the number of streams,
    and, where its periods are finer than ``MATRIX_COLUMNS`` a day, in time."""
    lengths = config.groupBy("stream_name").agg(F.first("group_interval", ignorenulls=True).alias("text")).select("stream_name", interval_ns(F.col("text")).alias("interval_ns"))
    nth = F.row_number().over(Window.partitionBy("interval_ns").orderBy("stream_name")) - 1
    rows = F.greatest(F.lit(1), whole_div(F.lit(MATRIX_CELLS), F.greatest(F.lit(1), whole_div(F.lit(DAY_NS), F.col("interval_ns")) + 1)))
    lengths = lengths.withColumn("block", whole_div(nth.cast("long"), rows))
    readings = frames.where("v0 is not null and not isnan(v0) and tm_ns is not null").select("stream_name", "tm_ns", "v0")
    placed = readings.join(lengths, "stream_name", "left").select(
        "stream_name",
        F.coalesce("interval_ns", F.lit(MINUTE_NS)).alias("interval_ns"),
        F.coalesce("block", -1 - F.pmod(F.xxhash64("stream_name"), F.lit(HASH_BLOCKS))).alias("block"),
        utc_day(F.col("tm_ns")).alias("day"),
        "tm_ns",
        F.when(F.abs("v0") < float("inf"), F.col("v0")).alias("v"),
    )
    k = whole_div(floor_to(F.col("tm_ns"), F.col("interval_ns")), F.col("interval_ns")).alias("k")
    day = ["day", "interval_ns", "block", "stream_name"]
    cells = placed.groupBy(*day, k).agg(F.avg("v").alias("value")).withColumn("mark", F.lit(False))
    stretch = whole_div(F.col("k"), MATRIX_COLUMNS)
    if not lengths.where(F.col("interval_ns") < DAY_NS // MATRIX_COLUMNS).isEmpty():
        # days of very fine periods: each stretch is told where the stream's day runs through it
        spans = cells.groupBy(*day).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        spans = spans.withColumn("s", F.explode(F.sequence(whole_div(F.col("lo"), MATRIX_COLUMNS), whole_div(F.col("hi"), MATRIX_COLUMNS))))
        ends = F.array(F.greatest("lo", F.col("s") * MATRIX_COLUMNS), F.least("hi", (F.col("s") + 1) * MATRIX_COLUMNS - 1))
        cells = cells.unionByName(spans.select(*day, F.explode(ends).alias("k"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("mark")))
        cells = cells.withColumn("stretch", F.when(F.col("interval_ns") < DAY_NS // MATRIX_COLUMNS, stretch))
    else:
        cells = cells.withColumn("stretch", F.lit(None).cast("long"))
    return cells.groupBy("day", "interval_ns", "block", "stretch").applyInArrow(
        _fill(rank), "stream_name string, period_start_ns long, interval_ns long, value double, status string"
    )


def empty_periods(grid: DataFrame) -> DataFrame:
    """The periods of `regular_grid` without a reading."""
    return grid.where(F.col("status") != OBSERVED).select("stream_name", "period_start_ns")


def held_out_errors(frames: DataFrame, config: DataFrame, share: int = 20, rank: int = RANK) -> DataFrame:
    """How well missing periods are filled: one period in ``share`` (by hash) is hidden before the completion and compared
    with what was measured. Per stream: hidden periods, those that came back filled, and the median absolute error of the
    fill, of the day's mean and of its median. Periods of infinite readings are left out."""
    whole = regular_grid(frames, config, rank).where((F.col("status") == OBSERVED) & F.col("value").isNotNull())
    length = F.coalesce("interval_ns", F.lit(MINUTE_NS))
    lengths = config.groupBy("stream_name").agg(F.first("group_interval", ignorenulls=True).alias("text")).select("stream_name", interval_ns(F.col("text")).alias("interval_ns"))
    hide = lambda start: F.pmod(F.xxhash64("stream_name", start), F.lit(share)) == 0
    kept = frames.join(lengths, "stream_name", "left").withColumn("_start", floor_to(F.col("tm_ns"), length)).where(~hide("_start")).drop("_start", "interval_ns")
    got = regular_grid(kept, config, rank).where(F.col("status") == FILLED).select("stream_name", "period_start_ns", F.col("value").alias("fill"))
    day = Window.partitionBy("stream_name", utc_day(F.col("period_start_ns")))
    seen = F.when(~hide("period_start_ns"), F.col("value"))
    truth = whole.withColumns({"mean": F.avg(seen).over(day), "middle": F.median(seen).over(day)}).where(hide("period_start_ns"))
    j = truth.join(got, ["stream_name", "period_start_ns"], "left")
    error = lambda c: F.median(F.when(F.col("fill").isNotNull(), F.abs(F.col(c) - F.col("value"))))
    return j.groupBy("stream_name").agg(F.count("*").alias("n_hidden"), F.count("fill").alias("n_filled"), error("fill").alias("fill_error"), error("mean").alias("mean_error"), error("middle").alias("median_error"))
