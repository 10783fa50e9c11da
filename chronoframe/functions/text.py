"""Frames and payloads as text: header lines, table lines, JSON of msgpack and schema-numbered payloads."""

from __future__ import annotations

import datetime
import json
import math
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions.frames import EVTNUM_NAMES, evtnum_name
from chronoframe.functions.times import floor_to, utc_day, whole_div
from chronoframe.operators.shredding import Invalid, Num, parse_msgpack
from chronoframe.schema import SECOND_NS

#: The word a header line starts with, unless another is given.
HEADER_WORD = "FRAME"
# Fixed values of the printed form: which payloads are shown, and how.
JSON_EVTNUM, JSON_RANGE = 14, (2000, 9999)
MSGPACK_EVTNUMS = (9, 15)
SCHEMA_EVTNUM = 16
PRETTY_PREFIX, PRETTY_INDENT = " " * 6, " " * 4
STRUCT_NAME_KEY = "-1"

_EPOCH = datetime.datetime(1970, 1, 1)


def float_text(x: float) -> str:
    """Shortest decimal that reads back as ``x``; exponents below -4 and from 21 on, at least two digits long."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-4 <= abs(x) < 1e16:
        plain = repr(x)
        return plain[:-2] if plain.endswith(".0") else plain
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    power = len(digits) + exponent - 1
    text = "".join(map(str, digits))
    if power < -4 or power >= 21:
        mantissa = text[0] + ("." + text[1:] if len(text) > 1 else "")
        body = f"{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"
    elif power < 0:
        body = "0." + "0" * (-power - 1) + text
    elif len(text) <= power + 1:
        body = text + "0" * (power + 1 - len(text))
    else:
        body = text[: power + 1] + "." + text[power + 1 :]
    return ("-" if sign else "") + body


def time_text(ns: int) -> str:
    """RFC 3339 in UTC with nanoseconds; trailing zeros of the fraction are left out."""
    seconds, rest = divmod(ns, 1_000_000_000)
    base = (_EPOCH + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S")
    if base[4] != "-":  # years before 1000 lose their zeros in some C libraries
        base = base.zfill(19)
    return base + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"


def name_of(evtnum: int) -> str:
    return EVTNUM_NAMES.get(evtnum, f"Ev.{evtnum}")


def indent_json(text: str) -> str:
    """White space only: four spaces a level after a prefix of six; the tokens stay as they are. Invalid JSON is
    returned unchanged."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return text
    out, level, i, n = [], 0, 0, len(text)
    newline = lambda: out.append("\n" + PRETTY_PREFIX + PRETTY_INDENT * level)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j
        elif c in "{[":
            j = i + 1
            while text[j] in " \t\r\n":
                j += 1
            if text[j] in "}]":
                out.append(c + text[j])
                i = j
            else:
                out.append(c)
                level += 1
                newline()
        elif c in "}]":
            level -= 1
            newline()
            out.append(c)
        elif c == ",":
            out.append(c)
            newline()
        elif c == ":":
            out.append(": ")
        elif c not in " \t\r\n":
            out.append(c)
        i += 1
    return "".join(out)


def json_text(x) -> str:
    """Canonical JSON: members sorted, no white space, numbers as they were; null for those JSON has not."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json_text(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(json_text, x)) + "]"
    if isinstance(x, Num):
        return "null" if x in ("NaN", "Infinity", "-Infinity") else str(x)
    return json.dumps(x, ensure_ascii=False)


# The extension types that hold a time.
TIME_EXTENSION, TIMESTAMP_EXTENSION = 1, 255


def _shown(kind: str, code: int, data: bytes):
    """Binaries and extension values as shown in JSON: times in nanoseconds since the epoch (type 1 as an integer, packed or
    of eight bytes; type -1 by its three public layouts), everything else as the text of its bytes."""
    if kind == "ext" and code == TIME_EXTENSION:
        if len(data) == 8:
            return Num(int.from_bytes(data, "big", signed=True))
        try:
            x = parse_msgpack(data)
        except Invalid:
            x = None
        if isinstance(x, Num) and x.lstrip("-").isdigit():
            return x
    if kind == "ext" and code == TIMESTAMP_EXTENSION and len(data) in (4, 8, 12):
        if len(data) == 8:
            word = int.from_bytes(data, "big")
            return Num((word & ((1 << 34) - 1)) * 10**9 + (word >> 34))
        nanos = int.from_bytes(data[:4], "big") if len(data) == 12 else 0
        return Num(int.from_bytes(data[-8:] if len(data) == 12 else data, "big", signed=len(data) == 12) * 10**9 + nanos)
    return data.decode("utf-8", "replace")


def msgpack_json(payload: bytes | None) -> str | None:
    """Canonical JSON of a msgpack payload, None if it is not wholly valid."""
    if payload is None:
        return None
    try:
        return json_text(parse_msgpack(payload, _shown))
    except (Invalid, RecursionError):
        return None


def schema_json(payload: bytes | None, schema: dict) -> str | None:
    """JSON of a payload whose member names are field numbers: the struct's name stands at -1, the schema document
    gives each number its tag. Members the schema does not know keep their number. None if invalid."""
    if payload is None:
        return None
    try:
        x = parse_msgpack(payload, _shown)
    except Invalid:
        return None

    def named(y):
        if not isinstance(y, dict) or STRUCT_NAME_KEY not in y:
            return y
        fields = schema.get("Structs", {}).get(y[STRUCT_NAME_KEY], {}).get("Fields", [])
        tags = {str(f["Zid"]): f.get("FieldTagName") or f.get("FieldGoName") for f in fields}
        return {tags.get(k, k): named(v) for k, v in y.items() if k != STRUCT_NAME_KEY}

    y = named(x)
    return "{" + ",".join(f"{json.dumps(k)}:{json_text(v)}" for k, v in y.items()) + "}" if isinstance(y, dict) else json_text(y)


def _shows_json(evtnum: int) -> bool:
    return evtnum == JSON_EVTNUM or JSON_RANGE[0] <= evtnum <= JSON_RANGE[1]


def header_line(tm_ns: int, pti: int, evtnum: int, nbytes: int, ucount: int, v0: float | None, v1: int | None, word: str = HEADER_WORD) -> str:
    s = f"{word} {time_text(tm_ns)} EVTNUM {name_of(evtnum)} [{nbytes} bytes] (UCOUNT {ucount})"
    if pti in (2, 3):
        s += f" V0:{float_text(v0)}"
    if pti in (1, 3):
        s += f" V1:{v1}"
    return s


def display_line(row: tuple, payload: bytes | None, i: int = -1, pretty: bool = False, skip_payload: bool = False, schema: dict | None = None) -> str:
    """Header line, after the row number if it is not negative, and the payload if it is JSON or msgpack, or numbered
    and a schema is given."""
    s = header_line(*row)
    if i >= 0:
        s = f"{i:06d} {s}"
    evtnum = row[2]
    if skip_payload:
        return s
    return s + _payload_text(evtnum, payload, indent_json if pretty else str, schema)


def table_line(tm_ns: int, pti: int, evtnum: int, v0: float | None, v1: int | None, payload: bytes | None) -> str:
    """One line for a statistics package's table reader."""
    s = f"{time_text(tm_ns)} evtnum {name_of(evtnum)}"
    if pti in (2, 3):
        s += f" V0 {float_text(v0)}"
    if pti in (1, 3):
        s += f" V1 {v1}"
    if _shows_json(evtnum):
        s += "  " + (payload or b"").decode("utf-8", "replace")
    elif evtnum in MSGPACK_EVTNUMS and (t := msgpack_json(payload)) is not None:
        s += f" '{t}'"
    return s


def _payload_text(evtnum: int, payload: bytes | None, shape, schema: dict | None) -> str:
    if _shows_json(evtnum):
        return "  " + shape((payload or b"").decode("utf-8", "replace"))
    if evtnum in MSGPACK_EVTNUMS and (t := msgpack_json(payload)) is not None:
        return " " + shape(t)
    if evtnum == SCHEMA_EVTNUM and schema is not None and (t := schema_json(payload, schema)) is not None:
        return " " + shape(t)
    return ""


@F.arrow_udf(T.StringType())
def float_texts(x: pa.Array) -> pa.Array:
    """`float_text` of a column; null for null."""
    return pa.array([None if v is None else float_text(v) for v in x.to_pylist()], pa.string())


def time_texts(tm: Column) -> Column:
    """`time_text` of a column of nanoseconds."""
    seconds = whole_div(floor_to(tm, SECOND_NS), SECOND_NS)
    rest, of_day = F.pmod(tm, F.lit(SECOND_NS)), F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat(two(whole_div(of_day, 3600)), F.lit(":"), two(F.pmod(whole_div(of_day, 60), F.lit(60))), F.lit(":"), two(F.pmod(of_day, F.lit(60))))
    fraction = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0"))))
    return F.concat(F.date_from_unix_date(utc_day(tm).cast("int")).cast("string"), F.lit("T"), clock, fraction, F.lit("Z"))


def _numbers(v0: str, v1: str) -> Column:
    """What follows the header where there are numbers."""
    pti = F.col("pti")
    a = F.when(pti.isin(2, 3), F.concat(F.lit(v0), F.coalesce(float_texts(F.when(pti.isin(2, 3), F.col("v0"))), F.lit("")))).otherwise("")
    return F.concat(a, F.when(pti.isin(1, 3), F.concat(F.lit(v1), F.coalesce(F.col("v1"), F.lit(0)).cast("string"))).otherwise(""))


def _is_json() -> Column:
    return (F.col("evtnum") == JSON_EVTNUM) | F.col("evtnum").between(*JSON_RANGE)


def _json_payload() -> Column:
    return F.coalesce(F.make_valid_utf8(F.col("payload").cast("string")), F.lit(""))


def stringify(number: Column | None = None, pretty: bool = False, skip_payload: bool = False, schema: dict | None = None, word: str = HEADER_WORD) -> Column:
    """Display line of each frame; with ``number`` its row number in front. Only numbers and payloads that need decoding go
    through Python."""
    evtnum = F.col("evtnum")
    line = F.concat(F.lit(f"{word} "), time_texts(F.col("tm_ns")), F.lit(" EVTNUM "), evtnum_name(evtnum), F.lit(" ["), F.col("nbytes").cast("string"), F.lit(" bytes] (UCOUNT "), F.col("ucount").cast("string"), F.lit(")"), _numbers(" V0:", " V1:"))
    if number is not None:
        line = F.concat(F.when(number >= 0, F.format_string("%06d ", number)).otherwise(""), line)
    if skip_payload:
        return line
    shape = pretty_json if pretty else (lambda c: c)
    packed = F.concat(F.lit(" "), shape(msgpack_to_json(F.when(evtnum.isin(*MSGPACK_EVTNUMS), F.col("payload")))))
    parts = [F.when(_is_json(), F.concat(F.lit("  "), shape(_json_payload()))), packed]
    if schema is not None:
        parts.append(F.concat(F.lit(" "), shape(schema_to_json(schema)(F.when(evtnum == SCHEMA_EVTNUM, F.col("payload"))))))
    return F.concat(line, F.coalesce(*parts, F.lit("")))


def header_text(number: Column | None = None) -> Column:
    return stringify(number, skip_payload=True)


def stringify_table() -> Column:
    """Table line of each frame."""
    evtnum = F.col("evtnum")
    line = F.concat(time_texts(F.col("tm_ns")), F.lit(" evtnum "), evtnum_name(evtnum), _numbers(" V0 ", " V1 "))
    packed = F.concat(F.lit(" '"), msgpack_to_json(F.when(evtnum.isin(*MSGPACK_EVTNUMS), F.col("payload"))), F.lit("'"))
    return F.concat(line, F.coalesce(F.when(_is_json(), F.concat(F.lit("  "), _json_payload())), packed, F.lit("")))


@F.arrow_udf(T.StringType())
def pretty_json(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else indent_json(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def msgpack_to_json(payload: pa.Array) -> pa.Array:
    return pa.array([msgpack_json(p) for p in payload.to_pylist()], pa.string())


def schema_to_json(schema: dict):
    @F.pandas_udf(T.StringType())
    def run(payload: pd.Series) -> pd.Series:
        return pd.Series([schema_json(None if p is None else bytes(p), schema) for p in payload])

    return run


@F.pandas_udf(T.BinaryType())
def json_to_msgpack(text: pd.Series) -> pd.Series:
    """msgpack of JSON texts (`to_json` of any columns); null for null."""
    return pd.Series([None if t is None else pack_msgpack(json.loads(t)) for t in text])


def pack_msgpack(x) -> bytes:
    """Smallest msgpack form of a JSON value."""
    import struct

    def head(n: int, fix: int, limit: int, codes: tuple) -> bytes:
        if n < limit:
            return bytes([fix | n])
        for code, form in codes:
            if n < 1 << (8 * struct.calcsize(form)):
                return bytes([code]) + struct.pack(form, n)
        raise ValueError("too long")

    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128 or -32 <= x < 0:
            return bytes([x & 0xFF])
        forms = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")) if x > 0 else ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))
        for code, form in forms:
            try:
                return bytes([code]) + struct.pack(form, x)
            except struct.error:
                continue
        return pack_msgpack(float(x))
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        b = x.encode()
        return head(len(b), 0xA0, 32, ((0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I"))) + b
    if isinstance(x, list):
        return head(len(x), 0x90, 16, ((0xDC, ">H"), (0xDD, ">I"))) + b"".join(map(pack_msgpack, x))
    return head(len(x), 0x80, 16, ((0xDE, ">H"), (0xDF, ">I"))) + b"".join(pack_msgpack(str(k)) + pack_msgpack(v) for k, v in x.items())


@F.pandas_udf(T.BinaryType())
def schema_to_msgpack(text: pd.Series, struct_name: pd.Series) -> pd.Series:
    """Payload by field number of JSON texts whose members are field numbers; the struct's name goes first, at -1."""
    out = []
    for t, name in zip(text, struct_name):
        members = {int(k): v for k, v in json.loads(t).items()}
        head = bytes([0x80 | (len(members) + 1)]) if len(members) < 15 else b"\xde" + (len(members) + 1).to_bytes(2, "big")
        out.append(head + b"\xff" + pack_msgpack(name) + b"".join(pack_msgpack(k) + pack_msgpack(v) for k, v in members.items()))
    return pd.Series(out)


# The field types of a schema document.
SCHEMA_TYPES = {
    "string": T.StringType(), "bool": T.BooleanType(), "float32": T.FloatType(), "float64": T.DoubleType(), "[]byte": T.BinaryType(),
    "int": T.LongType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
}


def schema_struct(schema: dict, name: str) -> T.StructType:
    """Spark type of a struct of a schema document, to read the JSON of its payloads with `from_json`. Maps have text
    keys in JSON; structs nest; unknown types are texts."""

    def kind(full: dict) -> T.DataType:
        text = full.get("Str", "")
        if text == "Map":
            return T.MapType(T.StringType(), kind(full["Range"]))
        if text in ("Slice", "Array"):
            return T.ArrayType(kind(full["Domain"]))
        if text == "Pointer":
            return kind(full["Domain"])
        return schema_struct(schema, text) if text in schema.get("Structs", {}) else SCHEMA_TYPES.get(text, T.StringType())

    fields = schema["Structs"][name]["Fields"]
    return T.StructType([T.StructField(f.get("FieldTagName") or f["FieldGoName"], kind(f.get("FieldFullType", {"Str": f.get("FieldTypeStr", "")}))) for f in sorted(fields, key=lambda f: f["Zid"])])


def display(frames: DataFrame, pretty: bool = False, skip_payload: bool = False, table: bool = False, schema: dict | None = None) -> DataFrame:
    """The lines (``value``, ready for `write.text`) of all sources in order of source and place, numbered from 1 across
    them; as table lines without numbers."""
    from chronoframe.operators.ordering import ranked

    if table:
        return frames.orderBy("source_id", "seq").select(stringify_table().alias("value"))
    r = ranked(frames, "source_id", "seq")
    return r.select("rank", stringify(F.col("rank") + 1, pretty, skip_payload, schema).alias("value")).orderBy("rank").select("value")
