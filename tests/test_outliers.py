import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import outliers as ol
from tests.makers import BASE, CONFIG, frame, frames_df

SEC = 10**9


def _run(spark, streams, config, extra=()):
    raws = [(s, f"f-{s}", frame(BASE + i * 10 * SEC, 2, float(v))) for s, vs in streams.items() for i, v in enumerate(vs)]
    f = frames_df(spark, [*raws, *extra])
    out = {}
    for r in ol.implausible(f.withColumn("spike", F.lit(1)), spark.createDataFrame(config, CONFIG)).collect():
        out.setdefault(r.source_id, {})[r.seq] = (r.impossible, r.spike, r.stuck)
    return out


@pytest.mark.parametrize("block", [200_000, 40])
def test_faults(spark, block, monkeypatch):
    monkeypatch.setattr(ol, "BLOCK", block)
    rng = np.random.default_rng(1)
    n = 600
    base = 20 + rng.standard_normal(n)
    spikes = base.copy()
    for i, k in ((0, 1), (50, 1), (120, 2), (200, 3), (300, 4), (400, 6), (n - 1, 1)):
        spikes[i : i + k] += 40
    spikes[500:] += 40  # a lasting change of level
    spikes[n - 1] += 40
    stuck = base.copy()
    stuck[100:140] = 20.0
    stuck[300:308] = 20.0
    hard = base.copy()
    hard[[10, 20, 30]] = [np.inf, -5000, 999]
    config = [("spikes", None, "C", None, None, 0.001), ("stuck", None, "C", None, None, 0.001), ("hard", None, "C", -100.0, 100.0, 0.001), ("code", None, "code", 0.0, 3.0, 0.0)]
    code = np.repeat([1.0, 2.0, 7.0, 0.0], 100)
    dup = [("spikes", "copy", frame(BASE + 50 * 10 * SEC, 2, float(spikes[50]))), ("hard", "nan", frame(BASE, 2, float("nan"))), (None, "null", frame(BASE, 2, float("inf")))]
    got = _run(spark, {"spikes": spikes, "stuck": stuck, "hard": hard, "code": code, "unknown": base}, config, dup)
    assert sorted(got["f-spikes"]) == [0, 50, 120, 121, 200, 201, 202, n - 1]
    assert all(x[:3] == (False, True, False) for x in got["f-spikes"].values())
    assert sorted(got["copy"]) == [0] and got["null"] == {0: (True, False, False)}
    assert sorted(got["f-stuck"]) == list(range(100, 140)) and all(x[2] for x in got["f-stuck"].values())
    assert {k: x[0] for k, x in got["f-hard"].items()} == {10: True, 20: True, 30: True}
    assert sorted(got["f-code"]) == list(range(200, 300))
    assert set(got) == {"f-spikes", "copy", "null", "f-stuck", "f-hard", "f-code"}


def test_long_holds_are_usual_for_step_streams(spark):
    rng = np.random.default_rng(2)
    steps = np.repeat(rng.permutation(40).astype(float), 15)
    assert _run(spark, {"steps": steps}, [("steps", None, "C", None, None, 0.1)]) == {}


def test_empty_and_tiny(spark):
    f = frames_df(spark, [("s", "a", frame(BASE, 2, 1.0)), ("s", "a", frame(BASE + 8, 5))])
    config = spark.createDataFrame([], CONFIG)
    assert ol.implausible(f, config).count() == 0
    assert ol.implausible(f.where("false"), config).count() == 0
    assert ol.implausible(f.withColumn("raw", F.lit(None).cast("binary")), config).count() == 0


def test_spikes_of_streams_without_scatter(spark):
    flat = np.tile([5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.5], 90)
    spikes = flat.copy()
    spikes[[50, 300]] = [60.0, 6.0]
    config = [("flat", None, "C", None, None, 0.1), ("free", None, "C", None, None, None)]
    assert _spikes(_run(spark, {"flat": spikes, "free": spikes}, config)) == {"f-flat": [50, 300]}


def test_an_hour_without_scatter_takes_that_of_the_stream(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([20 + rng.standard_normal(1440), np.tile([20.0, 20.0, 20.0, 20.0, 20.0, 21.0], 60)])
    v[1600] = 90.0
    got = _spikes(_run(spark, {"s": v}, [("s", None, "C", None, None, None)]))
    assert 1600 in got["f-s"]


def _spikes(got):
    return {k: sorted(i for i, x in v.items() if x[1]) for k, v in got.items() if any(x[1] for x in v.values())}
