"""Deeply nested payloads into flat tables by adjacency-table shredding.

Every value of a document becomes a node row: node, parent, label, ordinal and scalar. Object nodes joined with the
object that encloses them and with their scalar children give entity rows, which pivot into entity tables whose rows
name their parent. A document's nodes always come in one piece, so these joins need no shuffle.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.schema import EVTNUM_MAX, EVTNUM_MIN

NODE_SCHEMA = (
    "source_id string, seq long, node_id long, parent_id long, owner_id long, label string, ordinal long, kind string, "
    "scalar string, step string, general_step string"
)
ENTITY_SCHEMA = "source_id string, seq long, node_path string, parent_path string, path string, members map<string,string>"
OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL = "object", "array", "string", "number", "boolean", "null"


class Invalid(ValueError):
    """The payload is not wholly valid."""


class Num(str):
    """A number kept as the text it was written with."""

    __slots__ = ()


def _no_constant(text: str):
    raise Invalid(text)


_DECODER = json.JSONDecoder(parse_int=Num, parse_float=Num, parse_constant=_no_constant)
_SPACE = re.compile(r"[ \t\n\r]*")
_NUM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


def parse_json(data: bytes):
    """Strict JSON (RFC 8259): UTF-8, one value, no NaN or Infinity, no trailing text. Any depth of nesting."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Invalid(str(e)) from None
    try:
        at = _SPACE.match(text, 0).end()
        value, end = _DECODER.raw_decode(text, at)
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        raise Invalid(str(e)) from None
    if _SPACE.match(text, end).end() != len(text):
        raise Invalid("text after the value")
    return value


def _parse_deep(text: str):
    """The same grammar with an explicit stack, for documents nested deeper than the C scanner goes."""
    scan = json.decoder.scanstring
    skip = lambda i: _SPACE.match(text, i).end()
    root: list = []
    stack: list[tuple[object, str | None]] = []
    box, key, i, want = root, None, skip(0), "value"

    def put(value) -> None:
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)

    try:
        while True:
            if want == "value":
                c = text[i]
                if c == "{" or c == "[":
                    new: object = {} if c == "{" else []
                    put(new)
                    stack.append((box, key))
                    box, i = new, skip(i + 1)
                    if text[i] == ("}" if c == "{" else "]"):
                        i, want = i + 1, "pop"
                    else:
                        want = "key" if c == "{" else "value"
                    continue
                if c == '"':
                    value, i = scan(text, i + 1, True)
                elif text.startswith("true", i):
                    value, i = True, i + 4
                elif text.startswith("false", i):
                    value, i = False, i + 5
                elif text.startswith("null", i):
                    value, i = None, i + 4
                elif m := _NUM.match(text, i):
                    value, i = Num(m.group()), m.end()
                else:
                    raise Invalid(f"no value at {i}")
                put(value)
                want = "next"
            elif want == "key":
                if text[i] != '"':
                    raise Invalid(f"no member name at {i}")
                key, i = scan(text, i + 1, True)
                i = skip(i)
                if text[i] != ":":
                    raise Invalid(f"no colon at {i}")
                i, want = skip(i + 1), "value"
            elif want == "pop":
                box, key = stack.pop()
                want = "next"
            else:
                if box is root:
                    break
                i = skip(i)
                c, close = text[i], "}" if isinstance(box, dict) else "]"
                if c == ",":
                    i, want = skip(i + 1), "key" if close == "}" else "value"
                elif c == close:
                    i, want = i + 1, "pop"
                else:
                    raise Invalid(f"no comma at {i}")
    except (IndexError, ValueError) as e:
        raise Invalid(str(e)) from None
    if skip(i) != len(text):
        raise Invalid("text after the value")
    return root[0]


def _msgpack_head(data: bytes, i: int):
    """(kind, value or length, next position) of the item at ``i``, by the public msgpack specification."""
    b = data[i]
    if b <= 0x7F:
        return "num", b, i + 1
    if b >= 0xE0:
        return "num", b - 256, i + 1
    if b <= 0x8F:
        return "map", b & 15, i + 1
    if b <= 0x9F:
        return "arr", b & 15, i + 1
    if b <= 0xBF:
        return "str", b & 31, i + 1
    if b == 0xC0:
        return "const", None, i + 1
    if b in (0xC2, 0xC3):
        return "const", b == 0xC3, i + 1
    if b in _FIXED:
        kind, form, size = _FIXED[b]
        return kind, struct.unpack_from(form, data, i + 1)[0], i + 1 + size
    if 0xD4 <= b <= 0xD8:
        return "ext", 1 << (b - 0xD4), i + 1
    raise Invalid(f"byte {b:#x} at {i}")


_FIXED = {
    0xC4: ("bin", ">B", 1), 0xC5: ("bin", ">H", 2), 0xC6: ("bin", ">I", 4),
    0xC7: ("ext", ">B", 1), 0xC8: ("ext", ">H", 2), 0xC9: ("ext", ">I", 4),
    0xCA: ("num", ">f", 4), 0xCB: ("num", ">d", 8),
    0xCC: ("num", ">B", 1), 0xCD: ("num", ">H", 2), 0xCE: ("num", ">I", 4), 0xCF: ("num", ">Q", 8),
    0xD0: ("num", ">b", 1), 0xD1: ("num", ">h", 2), 0xD2: ("num", ">i", 4), 0xD3: ("num", ">q", 8),
    0xD9: ("str", ">B", 1), 0xDA: ("str", ">H", 2), 0xDB: ("str", ">I", 4),
    0xDC: ("arr", ">H", 2), 0xDD: ("arr", ">I", 4), 0xDE: ("map", ">H", 2), 0xDF: ("map", ">I", 4),
}


def _hex(kind: str, code: int, data: bytes):
    return data.hex()


def parse_msgpack(data: bytes, opaque=_hex):
    """One whole msgpack value, any depth. Binaries and extension values become what ``opaque(kind, type, bytes)`` gives,
    by default hexadecimal strings; member names that are not strings become their text."""
    root: list = []
    stack: list[list] = [[root, 1, None]]  # container, items to come, name waiting for its value
    i, size = 0, len(data)
    try:
        while stack:
            box, left, name = stack[-1]
            if not left:
                stack.pop()
                continue
            kind, value, i = _msgpack_head(data, i)
            if kind in ("str", "bin", "ext"):
                start = i + (kind == "ext")
                i = start + value
                if i > size:
                    raise Invalid("ends inside a value")
                value = data[start:i].decode("utf-8") if kind == "str" else opaque(kind, data[start - 1] if kind == "ext" else 0, data[start:i])
            elif kind == "num":
                value = Num(json.dumps(value))
            is_name = isinstance(box, dict) and name is None
            if is_name:
                if kind in ("map", "arr"):
                    raise Invalid("a container as a member name")
                stack[-1][2] = value if isinstance(value, str) else json.dumps(value)
                continue
            stack[-1][1] = left - 1
            stack[-1][2] = None
            count = value
            if kind == "map":
                value = {}
            elif kind == "arr":
                value = []
            if isinstance(box, dict):
                box[str(name)] = value
            else:
                box.append(value)
            if kind in ("map", "arr"):
                if count > size - i:
                    raise Invalid("more items than bytes")
                stack.append([value, count, None])
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise Invalid(str(e)) from None
    if i != size:
        raise Invalid("bytes after the value")
    return root[0]


PARSERS = {"json": parse_json, "msgpack": parse_msgpack}


def _step(name: str) -> str:
    return "/" + (name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name)


def nodes(value) -> Iterator[tuple]:
    """(node, parent, owner, label, ordinal, kind, scalar, step, general step) of every value, parents before children.
    The owner is the nearest enclosing object. Only objects have a step: their JSON Pointer (RFC 6901) from their owner,
    or the root; array indexes are ``*`` in the general one. Pointers are joined from steps, never kept per node."""
    stack = [(value, None, None, None, None, "", "")]
    n = 0
    while stack:
        x, parent, owner, label, ordinal, step, general = stack.pop()
        me, n = n, n + 1
        if isinstance(x, dict):
            yield me, parent, owner, label, ordinal, OBJECT, None, step, general
            new = []
            for i, (k, y) in enumerate(x.items()):
                below = _step(k) if isinstance(y, (dict, list)) else ""
                new.append((y, me, me, k, i, below, below))
            stack.extend(reversed(new))
        elif isinstance(x, list):
            yield me, parent, owner, label, ordinal, ARRAY, None, None, None
            general += "/*"
            stack.extend([(y, me, owner, str(i), i, f"{step}/{i}" if isinstance(y, (dict, list)) else "", general) for i, y in enumerate(x)][::-1])
        elif x is None:
            yield me, parent, owner, label, ordinal, NULL, None, None, None
        elif x is True or x is False:
            yield me, parent, owner, label, ordinal, BOOLEAN, "true" if x else "false", None, None
        else:
            yield me, parent, owner, label, ordinal, NUMBER if isinstance(x, Num) else STRING, str(x), None, None


def _texts(values) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # lone surrogates, which \u escapes can spell
        return pa.array([None if x is None else x.encode("utf-8", "replace").decode() for x in values], pa.string())


_NODE_TYPES = {
    "node_id": pa.int64(), "parent_id": pa.int64(), "owner_id": pa.int64(), "label": pa.string(), "ordinal": pa.int64(), "kind": pa.string(),
    "scalar": pa.string(), "step": pa.string(), "general_step": pa.string(),
}
BATCH_NODES = 50_000
BATCH_BYTES = 8 << 20


def _shredder(encodings: Encodings):
    """Kernel: payloads to node rows. A document's nodes are in one batch; a batch ends after the document that fills it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: list[tuple] = []
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(_NODE_TYPES)
            arrays = [_texts(c) if t == pa.string() else pa.array(c, t) for c, t in zip(cols, _NODE_TYPES.values())]
            source, seq, count = list(zip(*where)) if where else [[], [], []]
            of = pa.array(np.repeat(np.arange(len(count)), count))
            place = [pa.array(source, pa.string()).take(of), pa.array(seq, pa.int64()).take(of)]
            rows.clear()
            where.clear()
            return pa.RecordBatch.from_arrays([*place, *arrays], ["source_id", "seq", *_NODE_TYPES])

        for batch in batches:
            for source, seq, payload, parser in zip(*(batch.column(c).to_pylist() for c in ("source_id", "seq", "payload")), encodings.parsers(batch.column("evtnum"))):
                if parser is None:
                    continue
                try:
                    value = parser(payload)
                except Invalid:
                    continue
                before = len(rows)
                rows.extend(nodes(value))
                where.append((source, seq, len(rows) - before))
                held += len(payload)
                if len(rows) >= BATCH_NODES or held >= BATCH_BYTES:
                    yield flush()
                    held = 0
        yield flush()

    return run


def _paths(owner: list[int], objects: list[int], step: list[str]) -> Iterator[tuple[str, str]]:
    """(path, path of the enclosing object) of each object, in order. In this order an object's owner lies on the path
    just before it, so only lengths are kept."""
    length: dict[int, int] = {}
    current = ""
    for o, me, s in zip(owner, objects, step):
        above = current[: length[o]] if o is not None else ""
        current = above + s
        length[me] = len(current)
        yield current, above


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over node rows: objects joined with their owner's path and with their scalar children, by node."""
    names = [f.split(" ")[0] for f in ENTITY_SCHEMA.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node_id").to_numpy()
        start = np.maximum.accumulate(np.where(node == 0, np.arange(len(node)), 0))
        kind = batch.column("kind")
        is_object = pc.equal(kind, OBJECT).to_numpy(zero_copy_only=False)
        is_leaf = ~is_object & pc.not_equal(kind, ARRAY).to_numpy(zero_copy_only=False)
        parent = batch.column("parent_id").fill_null(-1).to_numpy()
        above = np.where(parent >= 0, start + parent, -1)
        leaves = np.flatnonzero(is_leaf & (above >= 0))
        leaves = leaves[is_object[above[leaves]]]
        leaves = leaves[np.argsort(above[leaves], kind="stable")]
        if pc.any(pc.match_substring(batch.column("label"), "?")).as_py():  # names of lone surrogates may be one text now; the last counts
            label = batch.column("label").to_pylist()
            leaves = np.array(sorted({(int(above[i]), label[i]): int(i) for i in leaves}.values(), key=lambda i: (above[i], i)), np.int64)
        objects = np.flatnonzero(is_object)
        upto = np.searchsorted(above[leaves], objects, side="right")
        below = np.searchsorted(above[leaves], objects, side="left")
        owner = batch.column("owner_id").take(pa.array(objects)).to_pylist()
        at = start[objects].tolist()
        own = [None if o is None else s + o for o, s in zip(owner, at)]
        step, general = (batch.column(c).take(pa.array(objects)).to_pylist() for c in ("step", "general_step"))
        first, held, path, parent_path, shape = 0, 0, [], [], []
        places = objects.tolist()
        for i, ((p, a), (g, _)) in enumerate(zip(_paths(own, places, step), _paths(own, places, general))):
            path.append(p)
            parent_path.append(a)
            shape.append(g)
            held += len(p) + len(a) + len(g)
            if held >= BATCH_BYTES or i == len(places) - 1:
                some = pa.array(objects[first : i + 1])
                inside = pa.array(leaves[below[first] : upto[i]])
                offsets = pa.array(np.append(below[first : i + 1], upto[i]) - below[first], pa.int32())
                members = pa.MapArray.from_arrays(offsets, batch.column("label").take(inside), batch.column("scalar").take(inside))
                yield pa.RecordBatch.from_arrays([batch.column("source_id").take(some), batch.column("seq").take(some), pa.array(path, pa.string()), pa.array(parent_path, pa.string()), pa.array(shape, pa.string()), members], names)
                first, held, path, parent_path, shape = i + 1, 0, [], [], []


class Encodings:
    """What the registry says about each event number: an index per number of the 21-bit range, so of fixed size however
    many ranges there are. The narrowest range that holds a number wins."""

    def __init__(self, registry: DataFrame) -> None:
        size = EVTNUM_MAX - EVTNUM_MIN + 1
        self.names: list[str | None] = [None]
        self.code = np.zeros(size, np.int16)
        width = np.full(size, np.iinfo(np.int64).max)
        known = registry.where("evtnum_from is not null and evtnum_to is not null and encoding is not null and evtnum_from <= evtnum_to")
        low, high = F.greatest("evtnum_from", F.lit(EVTNUM_MIN)).cast("long"), F.least("evtnum_to", F.lit(EVTNUM_MAX)).cast("long")
        name = F.when(F.col("encoding").isin(*PARSERS), F.col("encoding")).otherwise("")
        ranges = known.groupBy(low.alias("low"), high.alias("high")).agg(F.max(name).alias("name")).where("low <= high")
        for r in ranges.toLocalIterator():
            if r.name not in self.names:
                self.names.append(r.name)
            spot = slice(r.low - EVTNUM_MIN, r.high - EVTNUM_MIN + 1)
            narrower = width[spot] > r.high - r.low
            self.code[spot][narrower] = self.names.index(r.name)
            width[spot][narrower] = r.high - r.low

    def parsers(self, evtnum: pa.Array) -> list:
        by_code = [PARSERS.get(n) for n in self.names]
        e = evtnum.fill_null(EVTNUM_MIN - 1).to_numpy()
        inside = (e >= EVTNUM_MIN) & (e <= EVTNUM_MAX)
        return [by_code[c] for c in np.where(inside, self.code[np.where(inside, e - EVTNUM_MIN, 0)], 0).tolist()]

    def reach(self, column: str = "evtnum") -> Column:
        """A filter the scan can use: the stretches of numbers that have a parser, or all between them if there are many."""
        has = np.isin(self.code, [i for i, n in enumerate(self.names) if n in PARSERS])
        turn = np.flatnonzero(np.diff(has.astype(np.int8), prepend=0, append=0)) + EVTNUM_MIN
        pairs = list(zip(turn[::2].tolist(), (turn[1::2] - 1).tolist()))
        if len(pairs) > 32:
            pairs = [(pairs[0][0], pairs[-1][1])]
        c = F.lit(False)
        for a, b in pairs:
            c = c | F.col(column).between(a, b)
        return c


def _payloads(frames: DataFrame, registry: DataFrame) -> tuple[DataFrame, Encodings]:
    encodings = Encodings(registry)
    log = frames.where("pti = 7 and payload is not null").where(encodings.reach())
    return log.select("source_id", "seq", "payload", "evtnum"), encodings


def shred(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """The node table of every stored log frame (pti 7) whose payload the registry calls json or msgpack: source_id,
    seq, node_id, parent_id, owner_id (the nearest enclosing object), label, ordinal, kind, scalar, step.

    A payload that is null, damaged or followed by other bytes gives no node. Repeated frames give repeated nodes
    under their own (source_id, seq); of members named twice the last counts. Map-side only, no shuffle."""
    log, encodings = _payloads(frames, registry)
    return log.mapInArrow(_shredder(encodings), NODE_SCHEMA)


def all_entities(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """One entity row per object of every payload, the root too: source_id, seq, node_path, parent_path (of the nearest
    enclosing object, '' for the root or none), its general ``path`` (array indexes as ``*``) and ``members``, its scalar
    members as a map of texts. Null members have a null text; a member that is an object has its own rows, one that is
    an array none.

    The node table of `shred` is joined with itself where it arises: child objects with their owners, objects with their
    scalar children, by node. One pass, no shuffle."""
    log, encodings = _payloads(frames, registry)
    shredded = _shredder(encodings)
    return log.mapInArrow(lambda batches: _joined(shredded(batches)), ENTITY_SCHEMA)


def child_objects(entity_rows: DataFrame) -> DataFrame:
    """Every object below a root and the nearest object that encloses it."""
    return entity_rows.where("node_path <> ''").select("source_id", "seq", "node_path", "parent_path")


def entities(entity_rows: DataFrame, path: str, members: list[str]) -> DataFrame:
    """The entity table of the objects at ``path`` (array indexes written as ``*``; '' is the root), pivoted: source_id,
    seq, node_path, parent_path and one text column per name in ``members``. Absent and null members are null; a member
    that is an object or array has its own table and is null here."""
    columns = [F.try_element_at("members", F.lit(m)).alias(m) for m in members]
    return entity_rows.where(F.col("path") == path).select("source_id", "seq", "node_path", "parent_path", *columns)
