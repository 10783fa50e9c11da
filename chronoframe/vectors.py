"""Whole columns of frames from bytes and back. Only headers are walked frame by frame; everything else is array work on
the columns that are asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from chronoframe.codec import FIXED_SIZE
from chronoframe.schema import EVTNUM_MAX, EVTNUM_MIN, MAX_PAYLOAD, PTI_FLOAT, PTI_FLOAT_INT, PTI_INT, PTI_UDE, UCOUNT_BITS, UCOUNT_MASK, EvtnumOutOfRange, FrameTooLarge, NoDataAllowed, PayloadTooLong, TooShort

TYPES = {
    "nbytes": pa.int32(), "tm_ns": pa.int64(), "pti": pa.int8(), "evtnum": pa.int32(), "v0": pa.float64(), "v1": pa.int64(), "ucount": pa.int64(),
    "payload": pa.binary(), "raw": pa.binary(), "source_id": pa.string(), "seq": pa.int64(), "byte_offset": pa.int64(),
}


def frame_starts(data: bytes | memoryview, max_frame_bytes: int, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(starts, sizes, end of the last complete frame) of the frames in ``data``; `FrameTooLarge` if one is longer than
    allowed, whether or not it is complete."""
    starts: list[int] = []
    n = len(data)
    fixed = [FIXED_SIZE.get(p, 0) for p in range(8)]
    while at + 8 <= n:
        size = fixed[data[at] & 7]
        if not size:
            if at + 16 > n:
                break
            size = 16 + (int.from_bytes(data[at + 8 : at + 16], "little") & UCOUNT_MASK)
        if size > max_frame_bytes:
            raise FrameTooLarge(f"{size} bytes at {at}, {max_frame_bytes} allowed")
        if at + size > n:
            break
        starts.append(at)
        at += size
    s = np.array(starts, np.int64)
    return s, np.diff(s, append=at), at


def _words(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    return data[at[:, None] + np.arange(8)].view(kind).reshape(-1) if len(at) else np.empty(0, kind)


def decode(data, starts: np.ndarray, sizes: np.ndarray, names: list[str]) -> dict[str, pa.Array]:
    """The named columns of the frames at ``starts``; v0, v1 and payload are null where a frame carries none."""
    buffer = pa.py_buffer(data)
    b = np.frombuffer(buffer, np.uint8)
    n = len(starts)
    prim = _words(b, starts, "<i8")
    pti = (prim & 7).astype(np.int8)
    out: dict[str, pa.Array] = {}
    if "nbytes" in names:
        out["nbytes"] = pa.array(sizes, pa.int32())
    if "tm_ns" in names:
        out["tm_ns"] = pa.array(prim & ~np.int64(7))
    if "pti" in names:
        out["pti"] = pa.array(pti)
    typed = np.flatnonzero(pti == PTI_UDE)
    if {"evtnum", "ucount", "payload"} & set(names):
        word = _words(b, starts[typed] + 8, "<i8")
        evtnum, ucount = pti.astype(np.int32), np.zeros(n, np.int64)
        evtnum[typed], ucount[typed] = word >> UCOUNT_BITS, word & UCOUNT_MASK
        out["evtnum"], out["ucount"] = pa.array(evtnum), pa.array(ucount)
    if "v0" in names:
        at = np.flatnonzero((pti == PTI_FLOAT) | (pti == PTI_FLOAT_INT))
        v, none = np.zeros(n), np.ones(n, bool)
        v[at], none[at] = _words(b, starts[at] + 8, "<f8"), False
        out["v0"] = pa.Array.from_buffers(pa.float64(), n, [pa.array(~none).buffers()[1], pa.py_buffer(v)], null_count=int(none.sum()))
    if "v1" in names:
        v, none = np.zeros(n, np.int64), np.ones(n, bool)
        for kind, offset in ((PTI_INT, 8), (PTI_FLOAT_INT, 16)):
            at = np.flatnonzero(pti == kind)
            v[at], none[at] = _words(b, starts[at] + offset, "<i8"), False
        out["v1"] = pa.array(v, mask=none)
    if "payload" in names:
        view = memoryview(buffer)
        column: list = [None] * n
        for i in typed[ucount[typed] > 0].tolist():
            s = int(starts[i])
            column[i] = view[s + 16 : s + int(sizes[i]) - 1]
        out["payload"] = pa.array(column, pa.binary())
    if "raw" in names:
        ends = np.append(starts, starts[-1] + sizes[-1] if n else 0)
        if (starts[1:] == (starts + sizes)[:-1]).all() and ends[-1] < 1 << 31:
            out["raw"] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), buffer])
        else:
            view = memoryview(buffer)
            out["raw"] = pa.array([view[s : s + k] for s, k in zip(starts.tolist(), sizes.tolist())], pa.binary())
    return {c: out[c] for c in names if c in out}


def encode(tm: pa.Array, evtnum: pa.Array, v0: pa.Array, v1: pa.Array, payload: pa.Array) -> pa.Array:
    """Wire bytes from columns; null numbers are written as 0, NaN stays NaN, times are floored to 8 ns. A row without time
    or event number gives null."""
    n = len(tm)
    known = np.asarray(tm.is_valid()) & np.asarray(evtnum.is_valid())
    e = evtnum.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if ((e < EVTNUM_MIN) | (e > EVTNUM_MAX)).any():
        raise EvtnumOutOfRange(str(int(e[(e < EVTNUM_MIN) | (e > EVTNUM_MAX)][0])))
    pti = np.where((e >= 0) & (e < PTI_UDE), e, PTI_UDE)
    given = payload.to_pylist()
    length = np.array([len(p) if p else 0 for p in given], np.int64) if n else np.empty(0, np.int64)
    if (known & (length > 0) & (pti != PTI_UDE)).any():
        raise NoDataAllowed("EVTNUM 0 to 6 carry no payload")
    if (length > MAX_PAYLOAD).any():
        raise PayloadTooLong(str(int(length.max())))
    base = np.array([FIXED_SIZE.get(p, 16) for p in range(8)], np.int64)[pti]
    size = np.where(known, base + np.where((pti == PTI_UDE) & (length > 0), length + 1, 0), 0)
    start = np.append(0, np.cumsum(size))
    out = np.zeros(int(start[-1]), np.uint8)

    def put(rows: np.ndarray, offset: int, values: np.ndarray) -> None:
        if len(rows):
            out[(start[rows] + offset)[:, None] + np.arange(8)] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)

    every = np.flatnonzero(known)
    put(every, 0, ((tm.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8") & ~np.int64(7)) | pti)[every])
    floats = np.flatnonzero(known & ((pti == PTI_FLOAT) | (pti == PTI_FLOAT_INT)))
    put(floats, 8, v0.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")[floats])
    whole = v1.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    ints = np.flatnonzero(known & (pti == PTI_INT))
    put(ints, 8, whole[ints])
    both = np.flatnonzero(known & (pti == PTI_FLOAT_INT))
    put(both, 16, whole[both])
    typed = np.flatnonzero(known & (pti == PTI_UDE))
    put(typed, 8, ((e << UCOUNT_BITS) | np.where(length > 0, length + 1, 0))[typed])
    for i in typed[length[typed] > 0].tolist():
        s = int(start[i]) + 16
        out[s : s + int(length[i])] = np.frombuffer(given[i], np.uint8)
    if start[-1] >= 1 << 31:
        view = memoryview(out)
        return pa.array([bytes(view[a:b]) if k else None for a, b, k in zip(start[:-1].tolist(), start[1:].tolist(), known.tolist())], pa.binary())
    valid = None if known.all() else pa.array(known).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(out)])


def decode_values(raw: pa.Array, names: list[str]) -> dict[str, pa.Array]:
    """The named columns of the frame each binary value starts with; null for null. `TooShort` if one ends inside."""
    known = np.asarray(raw.is_valid())
    full = raw.drop_null() if not known.all() else raw
    full = full.cast(pa.large_binary())
    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
    data = full.buffers()[2] if full.buffers()[2] is not None else pa.py_buffer(b"")
    b = np.frombuffer(data, np.uint8)
    starts, have = offsets[:-1], np.diff(offsets)
    if (have < 8).any():
        raise TooShort("primary word")
    pti = b[starts] & 7 if len(starts) else np.empty(0, np.uint8)
    size = np.array([FIXED_SIZE.get(p, 16) for p in range(8)], np.int64)[pti]
    typed = np.flatnonzero(pti == PTI_UDE)
    if (have[typed] < 16).any():
        raise TooShort("second word")
    size[typed] += _words(b, starts[typed] + 8, "<i8") & UCOUNT_MASK
    if (have < size).any():
        raise TooShort(f"{int(size[have < size][0])} bytes needed")
    cols = decode(data, starts, size, names)
    if known.all():
        return cols
    spot = pa.array(np.where(known, np.cumsum(known) - 1, 0), mask=~known)
    return {c: x.take(spot) for c, x in cols.items()}
