"""The frame envelope: one row per stored record.

A frame is a nanosecond time whose three low bits carry the payload type (``pti``), optionally followed by a
float, an integer or a typed byte payload. ``raw`` holds the exact wire bytes and is a frame's identity.
"""

from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("nbytes", T.IntegerType()),
        T.StructField("tm_ns", T.LongType()),
        T.StructField("pti", T.ByteType()),
        T.StructField("evtnum", T.IntegerType()),
        T.StructField("v0", T.DoubleType()),
        T.StructField("v1", T.LongType()),
        T.StructField("ucount", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("raw", T.BinaryType()),
    ]
)

PTI_ZERO, PTI_INT, PTI_FLOAT, PTI_FLOAT_INT, PTI_NULL, PTI_NA, PTI_NAN, PTI_UDE = range(8)

EVTNUM_MIN, EVTNUM_MAX = -(1 << 20), (1 << 20) - 1
UCOUNT_BITS = 43
UCOUNT_MASK = (1 << UCOUNT_BITS) - 1
MAX_PAYLOAD = UCOUNT_MASK - 1
DEFAULT_MAX_FRAME_BYTES = 1 << 20
SMALLEST_FRAME = 8

SECOND_NS = 1_000_000_000
MINUTE_NS = 60 * SECOND_NS
HOUR_NS = 60 * MINUTE_NS
DAY_NS = 24 * HOUR_NS


class FrameError(ValueError):
    """A frame that cannot be built or read."""


class TooShort(FrameError):
    """The bytes end inside a frame."""


class NoDataAllowed(FrameError):
    """A payload was given for an EVTNUM of 0 to 6."""


class PayloadTooLong(FrameError):
    """The payload does not fit the 43-bit length."""


class EvtnumOutOfRange(FrameError):
    """The EVTNUM does not fit 21 signed bits."""


class FrameTooLarge(FrameError):
    """The frame is longer than the reader allows."""


class DuplicateDetected(FrameError):
    """Duplicate detection met its first duplicate; the text names the frame."""
