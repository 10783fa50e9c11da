import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.llm import digests as dg


def _rank_error(values, x, q):
    return max(0.0, q - (values <= x).mean(), (values < x).mean() - q)


@pytest.mark.parametrize("seed", range(4))
def test_merged_digests_stay_within_the_bound(seed):
    rng = np.random.default_rng(seed)
    values = [rng.standard_normal(20_000), rng.lognormal(0, 3, 20_000), rng.integers(0, 9, 20_000).astype(float), np.concatenate([np.full(9000, 5.0), rng.random(11_000)])][seed]
    parts = np.array_split(rng.permutation(values), 37)
    d = dg.merge([dg.digest_of(p) for p in parts])
    assert d[1].sum() == len(values) and len(d[0]) <= 3 * dg.DELTA
    for q in (0.001, 0.01, 0.25, 0.5, 0.9, 0.999):
        assert _rank_error(values, dg.quantile(d, q), q) <= dg.error_bound(q)


@settings(max_examples=40)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=60), st.sampled_from([0.0, 0.01, 0.3, 0.5, 0.99, 1.0]))
def test_few_values_are_exact(xs, q):
    values = np.array(xs)
    x = dg.quantile(dg.digest_of(values), q)
    assert _rank_error(values, x, q) <= 1 / len(xs) + 1e-12


def test_infinities_and_nothing():
    d = dg.digest_of(np.array([np.inf, -np.inf, -np.inf, np.nan, 1.0]))
    assert [dg.quantile(d, q) for q in (0.1, 0.5, 0.7, 0.9)] == [-np.inf, -np.inf, 1.0, np.inf]
    assert dg.quantile(dg.digest_of(np.array([np.nan])), 0.5) is None
    assert np.isfinite(dg.quantile(dg.digest_of(np.full(5000, 1.7e308)), 0.5))


def test_spark(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("a", 1, float(x)) for x in rng.standard_normal(4000)] + [("a", 2, float(x)) for x in rng.integers(0, 5, 3000)] + [(None, 1, 1.0), ("b", 1, None), ("b", 1, float("nan")), ("c", 1, float("inf"))]
    df = spark.createDataFrame(rows, "k string, day int, v double").withColumn("n", F.lit("clash")).repartition(6)
    got = {(r.k, r.day): r for r in dg.certified_percentiles(df, "v", ["k", "day"], delta=100).collect()}
    assert set(got) == {("a", 1), ("a", 2), (None, 1), ("c", 1)}
    assert all(r.certified for r in got.values()) and got[(None, 1)].p50 == 1.0 and got[("c", 1)].p50 == float("inf")
    values = np.array([r[2] for r in rows if r[:2] == ("a", 1)])
    assert abs(_rank_error(values, got[("a", 1)].p50, 0.5)) <= got[("a", 1)].rank_error
    days = dg.build_digests(df, "v", ["k", "day"], held=500)
    both = {r.k: r for r in dg.percentiles(dg.merge_digests(days, ["k"]), ["k"]).collect()}
    every = np.array([r[2] for r in rows if r[0] == "a"])
    assert both["a"].n == 7000 and all(_rank_error(every, x, q) <= dg.error_bound(q) for x, q in zip(both["a"].estimates, dg.QUANTILES))
    assert dg.certified_percentiles(df.where("false"), "v", ["k", "day"]).count() == 0


def test_merged_parts_are_certified(spark):
    rng = np.random.default_rng(3)
    days = [rng.normal(5 * d, 1 + d, 3000) for d in range(6)]
    rows = [("a", d, float(x)) for d, v in enumerate(days) for x in v] + [("b", 0, None), ("c", 0, float("-inf")), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double").repartition(5)
    got = {r.k: r for r in dg.certified_percentiles(df, "v", ["k"], parts=["day"]).collect()}
    every = np.concatenate(days)
    a = got["a"]
    assert set(got) == {"a", "c", None} and a.n == 18_000 and all(r.certified for r in got.values())
    errors = [_rank_error(every, a[f"p{round(q * 100):02d}"], q) for q in dg.QUANTILES]
    assert abs(a.rank_error - max(errors)) < 1e-12 and got["c"].p50 == float("-inf")


def test_stream_percentiles_are_certified(spark):
    import __spark_entry__ as entry

    assert entry.queries()["p5_stream_percentiles"](spark, "/root/testdata/sf0.001").columns[-2:] == ["rank_error", "certified"]


def test_certify_beyond_the_broadcast(spark, monkeypatch):
    """Groups and salts meet by a join where the estimates are too many to broadcast; the counts are the same."""
    df = spark.range(5000).selectExpr("if(id % 3 = 0, null, 'g' || id % 3) g", "double(id * 7919 % 5000) v")
    near = dg.certified_percentiles(df, "v", ["g"]).orderBy("g").collect()
    monkeypatch.setattr(dg, "SMALL_SIDE", 1)
    assert dg.certified_percentiles(df, "v", ["g"]).orderBy("g").collect() == near and all(r.certified for r in near)
