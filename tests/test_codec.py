import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe import codec
from chronoframe.functions import frames as ff
from chronoframe.schema import EvtnumOutOfRange, FrameTooLarge, NoDataAllowed, TooShort
from tests.makers import BASE

GOLDEN = [
    ((BASE, 0), "0000e18d06433314", -890982281767399130),
    ((BASE, 1, 0.0, -5), "0100e18d06433314fbffffffffffffff", -3493387687513649583),
    ((BASE, 2, 1.5), "0200e18d06433314000000000000f83f", -4693152243700011207),
    ((BASE, 3, -1.0, 4), "0300e18d06433314000000000000f0bf0400000000000000", 1579358783345416362),
    ((BASE, 4), "0400e18d06433314", 5246687822748879018),
    ((BASE, 5), "0500e18d06433314", 2980529086437922196),
    ((BASE, 6), "0600e18d06433314", -2910922183645130848),
    ((BASE, 13, 0.0, 0, b"fake msg"), "0700e18d06433314090000000068000066616b65206d736700", -6960927563974661075),
    ((BASE, -2), "0700e18d064333140000000000f0ffff", -476525178649754307),
    ((BASE, -1048576, 0.0, 0, b"x"), "0700e18d0643331402000000000000807800", 1702826792376956554),
    ((BASE, 14, 0.0, 0, b'{"k":1}'), "0700e18d0643331408000000007000007b226b223a317d00", 8800269534345865433),
]


@pytest.mark.parametrize("args,wire,checksum", GOLDEN)
def test_golden(args, wire, checksum):
    raw = codec.pack(*args)
    assert raw.hex() == wire
    assert codec.checksum64(raw) == checksum
    row, end = codec.unpack(raw)
    assert end == len(raw) == row["nbytes"]
    assert (row["tm_ns"], row["evtnum"]) == (args[0], args[1])


EVTNUMS = [-1048576, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 15, 2000, 9999, 1048575]


@given(st.integers(-(2**62), 2**62), st.sampled_from(EVTNUMS), st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1), st.binary(max_size=40))
def test_round_trip(tm, evtnum, v0, v1, payload):
    payload = payload if not 0 <= evtnum < 7 else None
    row, _ = codec.unpack(codec.pack(tm, evtnum, v0, v1, payload))
    assert row["tm_ns"] == tm - tm % 8
    assert row["evtnum"] == evtnum
    assert row["payload"] == (payload or None)
    assert row["v0"] == (v0 if evtnum in (2, 3) else None)
    assert row["v1"] == (v1 if evtnum in (1, 3) else None)


def test_errors():
    for e in range(7):
        with pytest.raises(NoDataAllowed):
            codec.pack(BASE, e, payload=b"x")
    for e in (-1048577, 1048576):
        with pytest.raises(EvtnumOutOfRange):
            codec.pack(BASE, e)
    for wire in ("", "01", "0100e18d06433314ff", "0700e18d06433314"):
        with pytest.raises(TooShort):
            codec.unpack(bytes.fromhex(wire))


def test_walk_tail_and_limit():
    a, b = codec.pack(BASE, 2, 1.0), codec.pack(BASE + 8, 13, payload=b"y" * 100)
    assert [at for _, at in codec.walk(a + b)] == [0, 16]
    assert [at for _, at in codec.walk(a + b[:-1])] == [0]
    assert codec.complete_length(a + b[:-1]) == 16
    with pytest.raises(TooShort):
        list(codec.walk(a + b[:-1], fail_fast=True))
    with pytest.raises(FrameTooLarge):
        list(codec.walk(a + b, max_frame_bytes=64))


def test_columns(spark):
    rows = [(BASE + 3, 2, 1.5, None, None), (BASE, 1, None, -5, None), (BASE, 13, None, None, b"fake msg"), (-5, 2, float("nan"), None, None), (BASE, 14, None, None, b"")]
    df = spark.createDataFrame(rows, "t long, e int, a double, b long, p binary")
    f = ff.to_frames(df, "t", "e", "a", "b", "p").collect()
    assert [bytes(r.raw).hex() for r in f[:3]] == [GOLDEN[2][1], GOLDEN[1][1], GOLDEN[7][1]]
    assert f[3].tm_ns == -8 and math.isnan(codec.unpack(bytes(f[3].raw))[0]["v0"])
    assert f[4].nbytes == 16 and f[4].payload is None
    back = spark.createDataFrame([(bytes(r.raw),) for r in f] + [(None,)], "raw binary").select(ff.decode_raw("raw").alias("r"), ff.checksum64("raw").alias("c")).select("r.*", "c").collect()
    assert [r.evtnum for r in back] == [2, 1, 13, 2, 14, None]
    assert math.isnan(back[3].v0) and back[5].raw is None and back[5].c is None
    assert back[0].c == GOLDEN[2][2]
    with pytest.raises(Exception, match="no payload allowed"):
        ff.to_frames(df.withColumn("e", F.lit(3)), "t", "e", "a", "b", "p").collect()
    with pytest.raises(Exception, match="out of range"):
        ff.to_frames(df.withColumn("e", F.lit(1 << 20)), "t", "e").collect()


def test_moved_time(spark):
    df = ff.to_frames(spark.createDataFrame([(BASE, 2, 1.5)], "t long, e int, a double"), "t", "e", "a")
    r = ff.set_time(df, F.col("tm_ns") + 20).collect()[0]
    assert r.tm_ns == BASE + 16 and codec.unpack(bytes(r.raw))[0]["tm_ns"] == r.tm_ns
