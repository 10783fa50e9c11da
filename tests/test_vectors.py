import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoframe import codec, vectors
from chronoframe.schema import EvtnumOutOfRange, FrameTooLarge, NoDataAllowed, TooShort

NAMES = ["nbytes", "tm_ns", "pti", "evtnum", "v0", "v1", "ucount", "payload", "raw"]
rows = st.lists(
    st.one_of(
        st.tuples(st.integers(-(2**62), 2**62), st.integers(0, 6), st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1), st.none()),
        st.tuples(st.integers(-(2**62), 2**62), st.one_of(st.integers(7, 2**20 - 1), st.integers(-(2**20), -1)), st.just(0.0), st.just(0), st.one_of(st.none(), st.binary(min_size=1, max_size=20))),
    ),
    max_size=12,
)


@settings(max_examples=150)
@given(rows)
def test_columns_equal_single_frames(values):
    cols = list(zip(*values)) if values else [[]] * 5
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.binary()]
    raw = vectors.encode(*(pa.array(c, t) for c, t in zip(cols, types)))
    want = [codec.pack(*v) for v in values]
    assert raw.to_pylist() == want
    data = b"".join(want)
    starts, sizes, end = vectors.frame_starts(data + b"\x07\x00", 1 << 20)
    assert end == len(data) and sizes.tolist() == [len(w) for w in want]
    for cols in (vectors.decode(data, starts, sizes, NAMES), vectors.decode_values(raw, NAMES)):
        for i, w in enumerate(want):
            row = codec.unpack(w)[0]
            assert {n: cols[n][i].as_py() for n in NAMES} == {n: row[n] for n in NAMES}


def test_nulls_and_errors():
    frame = codec.pack(8, 2, 1.5)
    got = vectors.decode_values(pa.array([None, frame, None], pa.binary()), ["v0", "raw"])
    assert got["v0"].to_pylist() == [None, 1.5, None] and got["raw"].to_pylist() == [None, frame, None]
    one = lambda e, p=None, t=8: vectors.encode(pa.array([t], pa.int64()), pa.array([e], pa.int32()), pa.array([None], pa.float64()), pa.array([None], pa.int64()), pa.array([p], pa.binary()))
    assert one(3).to_pylist() == [codec.pack(8, 3)] and one(None).to_pylist() == [None] and one(2, None, None).to_pylist() == [None]
    assert struct.unpack("<d", vectors.encode(pa.array([8]), pa.array([2], pa.int32()), pa.array([float("nan")]), pa.array([0]), pa.array([None], pa.binary()))[0].as_py()[8:])[0] != 0
    with pytest.raises(NoDataAllowed):
        one(3, b"x")
    with pytest.raises(EvtnumOutOfRange):
        one(1 << 20)
    with pytest.raises(TooShort):
        vectors.decode_values(pa.array([frame[:-1]], pa.binary()), ["v0"])
    with pytest.raises(FrameTooLarge):
        vectors.frame_starts(frame, 15)
