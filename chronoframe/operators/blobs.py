"""Byte-level joins of whole files: no record is parsed, lengths and checksums are validated.

Three kinds of content can be concatenated as bytes:

* ``frames``: a frame stream has no header or footer, so files simply follow each other;
* ``lines``: newline-delimited text. A missing last newline is added at the boundary, a byte order mark is dropped,
  and a header line (``header=True``) is kept once; files whose header differs are refused;
* ``zstd``: complete zstandard frames. Block headers are walked, nothing is decompressed; a file that ends inside
  a frame is refused, since everything after it would be lost.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

BOM = b"\xef\xbb\xbf"
# Fixed values of the zstandard format (RFC 8878).
ZSTD_MAGIC = 0xFD2FB528
ZSTD_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_DICT_ID_BYTES = (0, 1, 2, 4)
ZSTD_CONTENT_SIZE_BYTES = (0, 2, 4, 8)
# Fixed value: the polynomial of CRC-32 (IEEE 802.3), bits reversed.
CRC32_POLYNOMIAL = 0xEDB88320


class BrokenFile(ValueError):
    """A file that cannot be concatenated without losing or damaging records."""


def zstd_frames(data: bytes) -> int:
    """Number of complete zstandard frames that make up ``data`` exactly; raises `BrokenFile` otherwise."""
    at, n, size = 0, 0, len(data)

    def need(upto: int) -> None:
        if upto > size:
            raise BrokenFile(f"zstandard data ends inside a frame at byte {at}")

    while at < size:
        need(at + 4)
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in ZSTD_SKIPPABLE:
            need(at + 8)
            length = int.from_bytes(data[at + 4 : at + 8], "little")
            need(at + 8 + length)
            at += 8 + length
            continue
        if magic != ZSTD_MAGIC:
            raise BrokenFile(f"no zstandard frame at byte {at}")
        need(at + 5)
        flags = data[at + 4]
        single, checksum = flags & 0x20, flags & 0x04
        content = ZSTD_CONTENT_SIZE_BYTES[flags >> 6] or (1 if single else 0)
        at += 5 + (0 if single else 1) + ZSTD_DICT_ID_BYTES[flags & 3] + content
        last = False
        while not last:
            need(at + 3)
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, length = bool(head & 1), (head >> 1) & 3, head >> 3
            if kind == 3:
                raise BrokenFile(f"reserved block type at byte {at}")
            at += 3 + (1 if kind == 1 else length)
            need(at)
        if checksum:
            at += 4
            need(at)
        n += 1
    return n


def _times(matrix: tuple[int, ...], vector: int) -> int:
    """Product over bits."""
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@functools.lru_cache(maxsize=64)
def _zero_bytes(power: int) -> tuple[int, ...]:
    """What ``2 ** power`` appended zero bytes do to a CRC: a linear map, found by repeated squaring."""
    if power == -3:  # one bit
        return (CRC32_POLYNOMIAL, *(1 << i for i in range(31)))
    half = _zero_bytes(power - 1)
    return tuple(_times(half, x) for x in half)


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two pieces one after the other, from the CRC of each and the length of the second."""
    power = 0
    while length >> power:
        if length >> power & 1:
            first = _times(_zero_bytes(power), first)
        power += 1
    return first ^ second if length > 0 else first


@dataclass
class Joiner:
    """Joins contents one after another; `add` returns the bytes to append."""

    kind: str = "frames"
    header: bool = False
    n_files: int = 0
    bytes_in: int = 0
    bytes_out: int = 0
    added: int = 0
    dropped: int = 0
    crc: int = 0
    _header: bytes | None = None

    def add(self, data: bytes) -> bytes:
        out = bytes(data)
        if self.kind == "lines":
            out = self._lines(out)
        elif self.kind == "zstd":
            zstd_frames(out)
        elif self.kind != "frames":
            raise ValueError(f"unknown kind {self.kind!r}")
        self.n_files += 1
        self.bytes_in += len(data)
        self.bytes_out += len(out)
        self.crc = zlib.crc32(out, self.crc)
        return out

    def _lines(self, data: bytes) -> bytes:
        out = data
        if out.startswith(BOM):
            out = out[len(BOM) :]
        if out and not out.endswith(b"\n"):
            out += b"\n"
            self.added += 1
        if self.header and out:
            first, _, rest = out.partition(b"\n")
            first = first.rstrip(b"\r")
            if self._header is None:
                self._header = first
            elif first != self._header:
                raise BrokenFile("header lines differ")
            else:
                out = rest
        self.dropped += len(data) + (len(data) > 0 and not data.endswith(b"\n")) - len(out)
        return out

    def check(self) -> None:
        if self.bytes_in + self.added - self.dropped != self.bytes_out:
            raise BrokenFile(f"{self.bytes_in} bytes in, {self.bytes_out} out")
