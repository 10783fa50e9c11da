"""Frame bytes in plain Python: packing, unpacking and walking headers. The Spark side only ever calls it on batches.

All numbers are little-endian. The primary word is the time with its three low bits replaced by the payload type; a
typed payload has a second word of 21 bits type number (signed) and 43 bits length, which counts one trailing NUL.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from chronoframe.schema import (
    DEFAULT_MAX_FRAME_BYTES,
    EVTNUM_MAX,
    EVTNUM_MIN,
    MAX_PAYLOAD,
    PTI_FLOAT,
    PTI_FLOAT_INT,
    PTI_INT,
    PTI_UDE,
    UCOUNT_BITS,
    UCOUNT_MASK,
    EvtnumOutOfRange,
    FrameTooLarge,
    NoDataAllowed,
    PayloadTooLong,
    TooShort,
)

_Q, _D, _QQ, _QD, _QDQ = (struct.Struct(f) for f in ("<q", "<d", "<qq", "<qd", "<qdq"))
FIXED_SIZE = {0: 8, 1: 16, 2: 16, 3: 24, 4: 8, 5: 8, 6: 8}


def pack(tm_ns: int, evtnum: int, v0: float = 0.0, v1: int = 0, payload: bytes | None = None) -> bytes:
    """Wire bytes of one frame. The time is floored to 8 ns, also before 1970."""
    if not EVTNUM_MIN <= evtnum <= EVTNUM_MAX:
        raise EvtnumOutOfRange(str(evtnum))
    if payload and 0 <= evtnum < PTI_UDE:
        raise NoDataAllowed(f"EVTNUM {evtnum} carries no payload")
    if payload and len(payload) > MAX_PAYLOAD:
        raise PayloadTooLong(str(len(payload)))
    pti = evtnum if 0 <= evtnum < PTI_UDE else PTI_UDE
    prim = (tm_ns & ~7) | pti
    if pti == PTI_INT:
        return _QQ.pack(prim, v1)
    if pti == PTI_FLOAT:
        return _QD.pack(prim, v0)
    if pti == PTI_FLOAT_INT:
        return _QDQ.pack(prim, v0, v1)
    if pti != PTI_UDE:
        return _Q.pack(prim)
    count = len(payload) + 1 if payload else 0
    word = (evtnum << UCOUNT_BITS) | count
    return _QQ.pack(prim, word) + (payload + b"\x00" if payload else b"")


def frame_size(data: bytes | memoryview, at: int = 0) -> int:
    """Size of the frame that starts at ``at``, from its first 8 or 16 bytes."""
    if len(data) < at + 8:
        raise TooShort("primary word")
    pti = data[at] & 7
    if pti != PTI_UDE:
        return FIXED_SIZE[pti]
    if len(data) < at + 16:
        raise TooShort("second word")
    return 16 + (_Q.unpack_from(data, at + 8)[0] & UCOUNT_MASK)


def unpack(data: bytes | memoryview, at: int = 0) -> tuple[dict, int]:
    """(columns of the frame at ``at``, position after it). `TooShort` if the bytes end inside the frame."""
    size = frame_size(data, at)
    if len(data) < at + size:
        raise TooShort(f"{size} bytes needed at {at}")
    prim = _Q.unpack_from(data, at)[0]
    pti = prim & 7
    row = {"nbytes": size, "tm_ns": prim & ~7, "pti": pti, "evtnum": pti, "v0": None, "v1": None, "ucount": 0, "payload": None}
    if pti == PTI_INT:
        row["v1"] = _Q.unpack_from(data, at + 8)[0]
    elif pti in (PTI_FLOAT, PTI_FLOAT_INT):
        row["v0"] = _D.unpack_from(data, at + 8)[0]
        if pti == PTI_FLOAT_INT:
            row["v1"] = _Q.unpack_from(data, at + 16)[0]
    elif pti == PTI_UDE:
        word = _Q.unpack_from(data, at + 8)[0]
        row["evtnum"], row["ucount"] = word >> UCOUNT_BITS, word & UCOUNT_MASK
        if row["ucount"]:
            row["payload"] = bytes(data[at + 16 : at + size - 1])
    row["raw"] = bytes(data[at : at + size])
    return row, at + size


def walk(data: bytes | memoryview, max_frame_bytes: int = DEFAULT_MAX_FRAME_BYTES, fail_fast: bool = False) -> Iterator[tuple[dict, int]]:
    """(columns, offset) of each frame. A frame cut off at the end is dropped, or refused if ``fail_fast``."""
    at = 0
    while at < len(data):
        try:
            size = frame_size(data, at)
            if size > max_frame_bytes:
                raise FrameTooLarge(f"{size} bytes at {at}, {max_frame_bytes} allowed")
            row, after = unpack(data, at)
        except TooShort:
            if fail_fast:
                raise
            return
        yield row, at
        at = after


def complete_length(data: bytes | memoryview) -> int:
    """Bytes up to the end of the last complete frame."""
    at = 0
    try:
        while at < len(data):
            size = frame_size(data, at)
            if at + size > len(data):
                break
            at += size
    except TooShort:
        pass
    return at


def blake2b(raw: bytes) -> bytes:
    """BLAKE2b-512 of a frame; the trailing NUL of a payload is left out."""
    return hashlib.blake2b(raw[:-1] if raw[0] & 7 == PTI_UDE and len(raw) > 16 else raw).digest()


def checksum64(raw: bytes) -> int:
    """The first eight bytes of `blake2b`, as a signed little-endian number."""
    return _Q.unpack_from(blake2b(raw))[0]
