import random

import pytest
from pyspark.sql import functions as F

from chronoframe.llm.runs import collapse_runs
from tests.makers import BASE, CONFIG, frame, frames_df

DAY = 86400 * 10**9


def _brute(raws, bands):
    out = []
    groups = {}
    for stream, _, raw in raws:
        tm = int.from_bytes(raw[:8], "little", signed=True) & ~7
        if raw[0] & 7 < 7:
            groups.setdefault((stream, tm // DAY), set()).add((tm, raw))
    import struct

    for (stream, _), rows in groups.items():
        run = []
        for tm, raw in sorted(rows):
            pti = raw[0] & 7
            v = struct.unpack("<d", raw[8:16])[0] if pti in (2, 3) else None
            if run:
                p, u = run[-1][1:]
                same = p == pti and (v is None or v == u or (bands.get(stream) is not None and abs(v - u) <= bands[stream]))
                if not same:
                    if len(run) >= 3:
                        out.append((stream, run[0][0], run[-1][0], len(run)))
                    run = []
            run.append((tm, pti, v))
        if len(run) >= 3:
            out.append((stream, run[0][0], run[-1][0], len(run)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    raws = []
    for k in range(600):
        tm = BASE + DAY - 300 * 8 + k * 8
        s = rng.choice(["a", "b", None])
        pti = rng.choice([2, 2, 2, 2, 3, 0, 4, 6])
        v = rng.choice([1.0, 1.0, 1.05, 1.2, -0.0, 0.0, float("nan"), float("inf")])
        raws.append((s, "f", frame(tm, pti, v, rng.randrange(3))))
    raws += rng.sample(raws, 80) + [("a", "f", frame(BASE, 13, payload=b"x"))]
    f = frames_df(spark, raws).withColumn("run", F.lit(7))
    bands = {"a": 0.1}
    config = spark.createDataFrame([("a", None, None, None, None, 0.1), ("b", None, None, None, None, None)], CONFIG)
    for slice_ns in (80, DAY):
        got = sorted(map(tuple, collapse_runs(f, config, slice_ns=slice_ns).collect()), key=str)
        assert got == _brute(raws, bands)


def test_empty_and_nulls(spark):
    f = frames_df(spark, [("a", "f", frame(BASE + i * 8, 5)) for i in range(3)])
    config = spark.createDataFrame([], CONFIG)
    assert [tuple(r) for r in collapse_runs(f, config).collect()] == [("a", BASE, BASE + 16, 3)]
    assert collapse_runs(f.where("false"), config).count() == 0
    for c in ("tm_ns", "pti", "raw"):
        assert collapse_runs(f.withColumn(c, F.lit(None).cast(f.schema[c].dataType)), config).count() == 0
