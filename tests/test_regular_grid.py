import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import regular_grid as rg
from tests.makers import BASE, CONFIG, frame, frames_df

SEC, MIN = 10**9, 60 * 10**9


@pytest.mark.parametrize(
    "text,ns",
    [("1 min", MIN), ("300s", 300 * SEC), ("1/4h", 900 * SEC), ("2.5 min", 150 * SEC), ("min", MIN), (" Hour ", 3600 * SEC), ("3 MIN", 180 * SEC), ("600 sec", 600 * SEC), ("0.25 hour", 900 * SEC), ("5 m", 300 * SEC), ("2 hrs", 7200 * SEC), ("90 seconds", 90 * SEC), ("2h.", 7200 * SEC), (".5h", 1800 * SEC), ("1 / 2 hours", 1800 * SEC), (None, MIN), ("", MIN), ("  ", MIN), ("0 min", MIN), ("1/0 h", MIN), ("three days", MIN)],
)
def test_interval(spark, text, ns):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(rg.interval_ns(F.col("t"))).collect()[0][0] == ns


def test_low_rank_cells_are_recovered():
    rng = np.random.default_rng(0)
    full = 10 + rng.standard_normal((12, 2)) @ rng.standard_normal((2, 200))
    m = full.copy()
    gone = rng.random(m.shape) < 0.2
    m[gone] = np.nan
    m[:, 50] = np.nan  # nobody saw this column
    m[11] = np.nan  # nor this row
    filled, can = rg.complete(m)
    assert not can[:, 50].any() and not can[11].any()
    assert np.array_equal(filled[~np.isnan(m)], m[~np.isnan(m)])
    assert np.abs(filled - full)[can].max() < 0.8 and np.abs(filled - full)[can].mean() < 0.1 * full.std()


def test_grid(spark):
    day = 86400 * SEC
    raws = [("a", "f", frame(BASE + t, 2, v)) for t, v in ((0, 1.0), (10 * SEC, 3.0), (3 * MIN + 1, 5.0), (day - SEC, 1.0), (day + 5 * MIN, 2.0))]
    raws += [("a", "f", frame(BASE + 5 * MIN, 2, float("nan"))), ("a", "f", frame(BASE + 6 * MIN, 5)), ("b", "g", frame(BASE, 2, float("inf"))), ("c", "h", frame(BASE + 9 * MIN, 1, v1=5)), (None, "n", frame(BASE, 2, 1.0)), (None, "n", frame(BASE + 2 * MIN, 2, 1.0))]
    f = frames_df(spark, raws)
    f = f.unionByName(f.limit(1).withColumn("tm_ns", F.lit(None).cast("long"))).withColumn("text", F.lit("clash"))
    config = spark.createDataFrame([("a", "60 s", None, None, None, None)], CONFIG)
    rows = rg.regular_grid(f, config).collect()
    a = {(r.period_start_ns - BASE) // MIN: (r.value, r.status) for r in rows if r.stream_name == "a"}
    assert a[0] == (2.0, "observed") and a[3] == (5.0, "observed") and a[1] == (None, "unsupported") and len(a) == 1441
    assert {r.status for r in rows if r.stream_name == "b"} == {"observed"} and [r.value for r in rows if r.stream_name == "b"] == [None]
    assert sorted((r.period_start_ns - BASE) // MIN for r in rows if r.stream_name is None) == [0, 1, 2]
    assert not [r for r in rows if r.stream_name == "c"]
    assert rg.empty_periods(rg.regular_grid(f, config)).where("stream_name = 'a'").count() == 1441 - 4
    assert rg.regular_grid(f.where("false"), config).count() == 0
    assert rg.regular_grid(f, config.where("false")).count() == len(rows)


def test_filled_from_other_sources(spark):
    raws = []
    for k in range(6):
        for t in range(60):
            if not (k == 0 and 20 <= t < 30):
                raws.append((f"s{k}", f"f{k}", frame(BASE + t * MIN, 2, float((k + 1) * np.sin(t / 9) + k))))
    got = {(r.period_start_ns - BASE) // MIN: r for r in rg.regular_grid(frames_df(spark, raws), spark.createDataFrame([(f"s{k}", "1 min", None, None, None, None) for k in range(6)], CONFIG)).where("stream_name = 's0'").collect()}
    assert all(got[t].status == "filled" and abs(got[t].value - np.sin(t / 9)) < 0.1 for t in range(20, 30))
    assert got[10].status == "observed" and got[10].value == float(np.sin(10 / 9))


def test_departures_are_bridged():
    """A row that wanders for itself is filled from its neighbours in time, white noise is not; spikes set no scale."""
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.standard_normal((6, 400)), axis=1)
    noise = rng.standard_normal((2, 400))
    full = np.concatenate([walk, noise])
    m = full.copy()
    gone = rng.random(m.shape) < 0.1
    m[gone] = np.nan
    m[0, 5] = m[6, 7] = 1e6
    filled, can = rg.complete(m)
    error = np.where(gone & can, np.abs(filled - full), np.nan)
    assert np.nanmedian(error[:6]) < 1.5 and np.nanmedian(error[6:]) < 1.2
    assert filled[0, 5] == 1e6


def test_very_fine_periods(spark, monkeypatch):
    """A day cut in time: every period between the first and last reading is there once, also in stretches without any."""
    monkeypatch.setattr(rg, "MATRIX_COLUMNS", 100)
    config = spark.createDataFrame([(s, "1/1000 s", None, None, None, None) for s in "ab"], CONFIG)
    times = [5, 250, 251, 777]
    f = frames_df(spark, [(s, s, frame(BASE + t * 10**6, 2, float(t))) for s in "ab" for t in times])
    rows = rg.regular_grid(f, config).collect()
    for s in "ab":
        got = {(r.period_start_ns - BASE) // 10**6: r.status for r in rows if r.stream_name == s}
        assert sorted(got) == list(range(5, 778)) and {t for t, x in got.items() if x == "observed"} == set(times)
    assert len(rows) == 2 * 773
