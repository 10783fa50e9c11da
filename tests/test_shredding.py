import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.functions.text import pack_msgpack
from chronoframe.operators import shredding as sh
from tests.makers import BASE, frame, frames_df

REGISTRY = [(9, 9, "x", "msgpack"), (14, 14, "x", "json"), (2000, 9999, "x", "json"), (2500, 2500, "x", "opaque"), (13, 13, "x", "text")]
SCHEMA = "evtnum_from int, evtnum_to int, label string, encoding string"


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return json.loads(x) if isinstance(x, sh.Num) else x


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12)


@given(values, st.integers(0, 2))
def test_parsers_agree(x, indent):
    text = json.dumps(x, indent=indent or None)
    assert _plain(sh.parse_json(f" {text}\n".encode())) == x
    assert _plain(sh._parse_deep(f" {text}\n")) == x
    assert _plain(sh.parse_msgpack(pack_msgpack(x))) == x


@pytest.mark.parametrize("text", ["", " ", "{", '{"a":1,}', "[1,]", "{'a':1}", '{"a" 1}', "NaN", "[Infinity]", "01", "1 2", '{"a":1}x', '"\x01"', "[1 2]", "tru", "﻿{}", '{"a"', "[", '{1:2}', "-"])
def test_invalid_json(text):
    for parse in (lambda t: sh.parse_json(t.encode()), sh._parse_deep):
        with pytest.raises(sh.Invalid):
            parse(text)


@pytest.mark.parametrize("data", [b"", b"\xc1", b"\x81\xa1a", b"\xa5ab", b"\x01\x02", b"\x81\x90\x01", b"\xa1\xff", b"\xdd\xff\xff\xff\xff", b"\xcb\x00", b"\xc7\x04\x01ab"])
def test_invalid_msgpack(data):
    with pytest.raises(sh.Invalid):
        sh.parse_msgpack(data)
    with pytest.raises(sh.Invalid):
        sh.parse_json(b"\xff")


def test_very_deep():
    deep = "[" * 200_000 + "{}" + "]" * 200_000
    assert sum(1 for _ in sh.nodes(sh.parse_json(b'{"a":' * 3000 + b"1" + b"}" * 3000))) == 3001
    x = sh.parse_json(deep.encode())
    while isinstance(x, list):
        x, y = x[0], x
        y.clear()
    assert x == {}
    assert sh.parse_msgpack(b"\x91" * 5000 + b"\x80")


DOC = {"a/b": {"x~y": {}}, "list": [{"k": 1}, [{"m": {}}], "s"], "t": '{"not":"opened"}', "e": None, "spans": [{"id": 7, "name": "n", "deep": {}}, {"id": None}]}
OBJECTS = {("/a~1b", ""), ("/a~1b/x~0y", "/a~1b"), ("/list/0", ""), ("/list/1/0", ""), ("/list/1/0/m", "/list/1/0"), ("/spans/0", ""), ("/spans/0/deep", "/spans/0"), ("/spans/1", "")}


def test_shred(spark):
    payloads = [(14, json.dumps(DOC).encode()), (9, pack_msgpack(DOC)), (2101, json.dumps([DOC["spans"]]).encode()), (2500, json.dumps(DOC).encode()), (13, json.dumps(DOC).encode()), (14, b'{"a":{}'), (14, None), (9, b"\x81"), (14, b'{"\\ud800":{}}'), (14, b"{}")]
    f = frames_df(spark, [("s", "f", frame(BASE + i * 8, e, payload=p)) for i, (e, p) in enumerate(payloads)]).withColumn("node_path", F.lit("clash"))
    reg = spark.createDataFrame(REGISTRY, SCHEMA)
    got = {}
    for r in sh.child_objects(sh.all_entities(f, reg)).collect():
        got.setdefault(r.seq, set()).add((r.node_path, r.parent_path))
    assert got[0] == got[1] == OBJECTS
    assert got[2] == {("/0/0", ""), ("/0/0/deep", "/0/0"), ("/0/1", "")}
    assert set(got) == {0, 1, 2, 8}
    full = sh.all_entities(f, reg)
    nodes = sh.shred(f, reg)
    tree = {(r.seq, r.node_id): r for r in nodes.collect()}
    for r in tree.values():  # every node hangs on its parent, every owner is the nearest object above
        up = tree.get((r.seq, r.parent_id))
        assert (up is None) == (r.node_id == 0) and (up is None or up.kind in ("object", "array"))
        assert r.owner_id == (None if up is None else up.node_id if up.kind == "object" else up.owner_id)
    assert sorted(r.scalar for r in tree.values() if r.seq == 0 and r.kind == "number") == ["1", "7"]
    spans = sorted((r.seq, r.node_path, r.parent_path, r.id, r.name, r.deep) for r in sh.entities(full, "/spans/*", ["id", "name", "deep"]).collect())
    assert spans == [(s, p, "", i, n, None) for s in (0, 1) for p, i, n in (("/spans/0", "7", "n"), ("/spans/1", None, None))]
    assert sh.shred(f.where("false"), reg).count() == 0 and sh.shred(f, reg.where("false")).count() == 0


def test_entities_of_every_path(spark):
    import __spark_entry__

    assert "p3_entities" in __spark_entry__.queries()
    payloads = [(14, json.dumps(DOC).encode()), (9, pack_msgpack(DOC)), (14, b'[1,[2],{"b":true,"a":1.50}]'), (14, b'{"\\ud800":1,"\\ud801":2}'), (14, b"7"), (14, b"{}"), (14, b'{"a":{}')]
    f = frames_df(spark, [("s", "f", frame(BASE + i * 8, e, payload=p)) for i, (e, p) in enumerate(payloads)])
    got = {}
    for r in sh.all_entities(f, spark.createDataFrame(REGISTRY, SCHEMA)).collect():
        assert r.node_path not in got.setdefault(r.seq, {})
        got[r.seq][r.node_path] = (r.parent_path, r.path, r.members)
    assert {(k, v[0]) for k, v in got[0].items()} == OBJECTS | {("", "")} and got[0] == got[1]
    assert got[0][""] == ("", "", {"t": '{"not":"opened"}', "e": None})
    assert got[0]["/list/0"] == ("", "/list/*", {"k": "1"}) and got[0]["/list/1/0/m"] == ("/list/1/0", "/list/*/*/m", {})
    assert got[0]["/spans/0"][1:] == ("/spans/*", {"id": "7", "name": "n"}) and got[0]["/spans/1"][2] == {"id": None}
    assert got[2] == {"/2": ("", "/*", {"b": "true", "a": "1.50"})} and got[3] == {"": ("", "", {"?": "2"})} and got[5] == {"": ("", "", {})}
    assert set(got) == {0, 1, 2, 3, 5}


def test_digits_as_member_names(spark):
    """A member called 1 is no index."""
    doc = {"spans": {"1": {"id": "x"}}, "1": [{"2": {"id": "y"}}]}
    f = frames_df(spark, [("s", "f", frame(BASE, 14, payload=json.dumps(doc).encode()))])
    rows = sh.all_entities(f, spark.createDataFrame(REGISTRY, SCHEMA))
    assert sh.entities(rows, "/spans/*", ["id"]).count() == 0
    assert [tuple(r) for r in sh.entities(rows, "/1/*/2", ["id", "none"]).collect()] == [("f", 0, "/1/0/2", "/1/0", "y", None)]


def test_nested_arrays_and_long_chains(spark):
    payloads = [b"[" * 20_000 + b"{}" + b"]" * 20_000, b'{"a":' * 3000 + b"{}" + b"}" * 3000]
    f = frames_df(spark, [("s", "f", frame(BASE + 8 * i, 14, payload=p)) for i, p in enumerate(payloads)])
    rows = sh.child_objects(sh.all_entities(f, spark.createDataFrame(REGISTRY, SCHEMA)))
    assert rows.selectExpr("max(length(node_path))", "count(*)").collect()[0] == (40_000, 3001)
    assert rows.where("seq = 1 and node_path <> parent_path || '/a'").count() == 0


def test_registry_of_many_ranges(spark):
    ranges = spark.range(100_000).selectExpr("cast(id * 8 as int) evtnum_from", "cast(id * 8 + id % 7 as int) evtnum_to", "'x' label", "if(id % 2 = 0, 'json', 'opaque') encoding")
    wide = spark.createDataFrame([(-5, 9, "w", "json"), (None, 3, "n", "json"), (2, 1, "n", "json"), (-(1 << 30), 1 << 30, "w", "opaque")], SCHEMA)
    f = frames_df(spark, [("s", "f", frame(BASE + e * 8, e, payload=b'{"a":{}}')) for e in (7, 8, 16, 17, 24, 800_000 - 16, 800_000 - 8, -3, -6)])
    got = {r.seq for r in sh.child_objects(sh.all_entities(f, ranges.unionByName(wide).unionByName(wide))).collect()}
    assert got == {0, 2, 3, 5, 7}
