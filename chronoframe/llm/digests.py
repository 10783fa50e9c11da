"""Percentiles of very large numeric columns by merging centroid digests, with a certified rank error.

A digest clusters sorted values under a size function that is fine at both ends: a cluster that starts at quantile q
may reach as far as ``k(q) = delta / (2 pi) * asin(2 q - 1)`` grows by one. Digests of partitions, files, days or
streams merge by clustering their centroids again. A second pass counts the values below each estimate, so the rank
error that is reported is measured, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.arrow import bounds
from chronoframe.session import cut_lineage, small_enough

DELTA = 1000
SALTS = 32
#: Levels at which values are clustered: where they are read, per salt, per group; with parts, per salt and group again.
LEVELS, LEVELS_WITH_PARTS = 3, 5
PENDING = 64
SMALL_SIDE = 100_000
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
FIELDS = ["means", "weights", "lows", "highs", "n_low", "n_high"]
DIGEST_FIELDS = "means array<double>, weights array<long>, lows array<double>, highs array<double>, n_low long, n_high long"


def cluster(means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray, delta: int = DELTA) -> list[np.ndarray]:
    """Cluster weighted centroids, sorted by mean. Equal single values become one centroid, and a value that alone
    outweighs a cluster keeps one of its own, so tied values are held exactly."""
    if not len(means):
        return [means, weights, lows, highs]
    order = np.lexsort((highs, lows, means))
    m, w, lo, hi = means[order], weights[order], lows[order], highs[order]
    same = (m[1:] == m[:-1]) & (lo[1:] == hi[1:]) & (lo[:-1] == hi[:-1])
    start = np.flatnonzero(np.append(True, ~same))
    m, w, lo, hi = m[start], np.add.reduceat(w, start), lo[start], hi[start]
    if len(m) > delta // 2:
        total = w.sum()
        middle = (np.cumsum(w) - w / 2) / total
        k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * middle - 1, -1, 1))).astype(np.int64)
        heavy = w * delta > total
        cut = np.append(True, (np.diff(k) != 0) | heavy[1:] | heavy[:-1])
        start = np.flatnonzero(cut)
        weight = np.add.reduceat(w, start)
        scale = max(np.abs(m).max(), 1e-300)  # sums of the largest doubles would overflow
        mean = np.add.reduceat(m / scale * w, start) / weight * scale
        one = np.diff(np.append(start, len(m))) == 1
        m, w = np.where(one, m[start], mean), weight
        lo, hi = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
    return [m, w, lo, hi]


def quantile(digest: list, q: float) -> float | None:
    """Estimate of the ``q`` quantile: the place of its rank within the range of the cluster that holds it. Infinities
    count at their ends; None if there are no values."""
    _, weights, lows, highs, n_low, n_high = digest
    inner = int(weights.sum()) if len(weights) else 0
    n = inner + n_low + n_high
    if not n:
        return None
    rank = min(max(q * n, 1.0), float(n))
    if rank <= n_low:
        return float("-inf")
    rank -= n_low
    if rank > inner:
        return float("inf")
    upto = np.cumsum(weights)
    i = int(np.searchsorted(upto, rank, side="left"))
    share = (rank - (upto[i] - weights[i])) / weights[i]
    return float(lows[i] * (1 - share) + highs[i] * share) if lows[i] != highs[i] else float(lows[i])


def merge(digests: list, delta: int = DELTA) -> list:
    """One digest of several: their centroids are clustered again."""
    return [*cluster(*(np.concatenate([d[i] for d in digests]) for i in range(4)), delta), sum(d[4] for d in digests), sum(d[5] for d in digests)]


def digest_of(values: np.ndarray, delta: int = DELTA) -> list:
    """Digest of raw values; NaN is no value."""
    v = values[np.isfinite(values)].astype(float)
    return [*cluster(v, np.ones(len(v), np.int64), v, v, delta), int((values == -np.inf).sum()), int((values == np.inf).sum())]


def _digest(row: dict) -> list:
    return [np.array(row["means"], float), np.array(row["weights"], np.int64), np.array(row["lows"], float), np.array(row["highs"], float), row["n_low"], row["n_high"]]


def _batch(names: list[str], types: list, keys: list[tuple], digests: list) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
    kinds = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64()]
    cols.extend(pa.array([d[i] for d in digests], t) for i, t in enumerate(kinds))
    return pa.RecordBatch.from_arrays(cols, [*names, *FIELDS])


def _build(by: list[str], delta: int, held: int):
    """Kernel over any order of rows: a digest per group and about ``held`` rows, whatever the group's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, types, n = [], None, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            codes = [table.column(c).combine_chunks().dictionary_encode() for c in by]
            code, size = np.zeros(table.num_rows, np.int64), 1
            for c in codes:
                code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
                size *= len(c.dictionary) + 1
            value = table.column("value").to_numpy()
            order = np.argsort(code, kind="stable")
            edges = [*np.flatnonzero(np.diff(code[order], prepend=-1)).tolist(), len(order)]
            keys = table.select(by).take(pa.array(order[edges[:-1]])).to_pylist()
            return _batch(by, types, [tuple(k.values()) for k in keys], [digest_of(value[order[s:e]], delta) for s, e in zip(edges, edges[1:])])

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            parts.append(batch)
            n += batch.num_rows
            if n >= held:
                yield flush()
                parts, n = [], 0
        if n:
            yield flush()

    return run


def _merger(by: list[str], delta: int):
    """Kernel over digests sorted by group; holds one group's digest and ``PENDING`` more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, pending, keys, done, types = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in by]
            edges = bounds(batch, by)
            for s, e in zip(edges, edges[1:]):
                for row in batch.slice(s, e - s).to_pylist():
                    this = tuple(row[c] for c in by)
                    if this != ident:
                        if ident is not None:
                            keys.append(ident)
                            done.append(merge(pending, delta))
                        ident, pending = this, []
                    pending.append(_digest(row))
                    if len(pending) > PENDING:
                        pending = [merge(pending, delta)]
            if len(keys) > 500:
                yield _batch(by, types, keys, done)
                keys, done = [], []
        if ident is not None:
            keys.append(ident)
            done.append(merge(pending, delta))
            yield _batch(by, types, keys, done)

    return run


def _types(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def merge_digests(digests: DataFrame, by: list[str], delta: int = DELTA) -> DataFrame:
    """One digest per group of ``by``: first per group and salt, so that a group with many digests is merged by many
    tasks, then per group."""
    salted = digests.select(*by, *FIELDS).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    first = [*by, "salt"]
    level = salted.repartition(*first).sortWithinPartitions(*first).mapInArrow(_merger(first, delta), f"{_types(salted, first)}, {DIGEST_FIELDS}").drop("salt")
    return level.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merger(by, delta), f"{_types(digests, by)}, {DIGEST_FIELDS}")


def build_digests(df: DataFrame, value: str, by: list[str], delta: int = DELTA, held: int = 200_000) -> DataFrame:
    """One digest per group: rows are digested where they are, only digests are shuffled.

    Null and NaN are no values, infinities are. Groups without values have no row; a null group is a group."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("value"))
    return merge_digests(rows.mapInArrow(_build(by, delta, held), f"{_types(df, by)}, {DIGEST_FIELDS}"), by, delta)


def error_bound(q: float, delta: int = DELTA, levels: int = LEVELS) -> float:
    """Rank error, as a share of the values, that a digest of ``delta`` stays within: at each level at which values were
    clustered, the width of the cluster at q."""
    return levels * (2 * np.pi / delta) * float(np.sqrt(q * (1 - q))) + (2 * np.pi / delta) ** 2


def percentiles(digests: DataFrame, by: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``n`` and ``estimates`` (one per quantile) of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for r in batch.select(FIELDS).to_pylist():
                d = _digest(r)
                n.append(int(d[1].sum()) + d[4] + d[5])
                out.append([quantile(d, q) for q in qs])
            cols = [batch.column(c) for c in by]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.float64()))], [*by, "n", "estimates"])

    return digests.mapInArrow(run, f"{_types(digests, by)}, n long, estimates array<double>")


def certify(df: DataFrame, value: str, by: list[str], estimates: DataFrame, qs: tuple[float, ...] = QUANTILES, delta: int = DELTA, levels: int = LEVELS) -> DataFrame:
    """Second pass: counts the values below and up to each estimate. Yields the estimates with ``rank_error`` (the
    largest distance between a wanted and a held rank, as a share of n) and ``certified`` (all within `error_bound`).

    Counts are combined before they are shuffled. The estimates are broadcast if counted small; else values and estimates
    meet by group and salt, so that a group with most of the values is spread over many tasks."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("value"))
    side = estimates.select(*[F.col(c).alias(f"e_{c}") for c in by], "estimates")
    same = None
    if small_enough(side, SMALL_SIDE):
        side = F.broadcast(side)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        side = side.withColumn("e_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("salt") == F.col("e_salt")
    for c in by:
        x = F.col(c).eqNullSafe(F.col(f"e_{c}"))
        same = x if same is None else same & x
    counts = [f(i) for i in range(len(qs)) for f in (lambda i: F.count_if(F.col("value") < F.col("estimates")[i]).alias(f"lt{i}"), lambda i: F.count_if(F.col("value") <= F.col("estimates")[i]).alias(f"le{i}"))]
    counted = rows.join(side, same).groupBy(*by).agg(F.count("*").alias("n"), *counts, F.first("estimates").alias("estimates"))
    errors = [F.greatest(F.lit(0.0), F.lit(q) - F.col(f"le{i}") / F.col("n"), F.col(f"lt{i}") / F.col("n") - F.lit(q)) for i, q in enumerate(qs)]
    within = None
    for e, q in zip(errors, qs):
        # a quantile between two values may be either of them, hence one value of play
        x = e <= error_bound(q, delta, levels) + 1 / F.col("n")
        within = x if within is None else within & x
    return counted.select(*by, "n", "estimates", F.greatest(*errors).alias("rank_error") if len(errors) > 1 else errors[0].alias("rank_error"), within.alias("certified"))


def certified_percentiles(df: DataFrame, value: str, by: list[str], qs: tuple[float, ...] = QUANTILES, delta: int = DELTA, parts: list[str] | None = None) -> DataFrame:
    """Per group: n, one column per quantile (``p50`` for 0.5), rank_error and certified. With ``parts``, digests are
    built per group and part and merged; what the merging adds to the error is in rank_error, the bound stays."""
    digests = build_digests(df, value, [*by, *(parts or [])], delta)
    estimates = cut_lineage(percentiles(merge_digests(digests, by, delta) if parts else digests, by, qs))
    sure = certify(df, value, by, estimates, qs, delta, LEVELS_WITH_PARTS if parts else LEVELS)
    return sure.select(*by, "n", *(F.col("estimates")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(qs)), "rank_error", "certified")
