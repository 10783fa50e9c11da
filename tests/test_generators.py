import json

import pytest
from pyspark.sql import functions as F

from chronoframe import codec
from chronoframe import generators as gen
from chronoframe.functions import frames as ff
from chronoframe.functions import text as tx
from chronoframe.operators import grouping
from chronoframe.sources.frames import read_frames, write_frames
from tests.test_text import LOG_SCHEMA


def test_shapes(spark):
    rows = gen.mixed(spark, 9).orderBy("seq").collect()
    assert [r.evtnum for r in rows] == [15, 0, 3] * 3 and rows[5].v0 == 5.0 and rows[5].v1 == 5
    for r in rows:
        assert codec.unpack(bytes(r.raw))[0]["payload"] == (bytes(r.payload) if r.payload is not None else None)
        assert r.payload is None or bytes(r.payload) == bytes(range(len(r.payload)))
    assert [r.v0 for r in gen.repeats(spark, [2, 1]).orderBy("seq").collect()] == [0.0, 0.0, 1.0]
    assert gen.floats(spark, 5).agg(F.sum("v0")).collect()[0][0] == 10.0 and gen.pairs(spark, 5).where("v1 = 0").count() == 5
    base = 1500000000000000000
    g = gen.gapped(spark, base, [3, 0, 7.5, -2], [1, 2, 9, 4], [10, 20, 30, 30]).orderBy("seq").collect()
    assert [(r.v0, r.v1, (r.tm_ns - base) // 10**9) for r in g] == [(3.0, 1, 10), (7.5, 9, 30), (-2.0, 4, 30)]


def test_log_entries(spark):
    f = gen.log_entries(spark, 3)
    first = f.where("seq = 0").collect()[0]
    assert bytes(first.payload).hex() == "82ffa84c6f67456e74727901a3307830"
    lines = [r.value for r in tx.display(f, schema=LOG_SCHEMA).collect()]
    assert lines[0].startswith("000001 ") and lines[0].endswith('{"op":"0x0"}') and lines[2].endswith('{"lsn":2,"op":"0x2"}')
    full = {"Structs": {"LogEntry": {"Fields": [{"Zid": 0, "FieldTagName": "lsn", "FieldFullType": {"Str": "int64"}}, {"Zid": 1, "FieldTagName": "op", "FieldFullType": {"Str": "string"}}, {"Zid": 2, "FieldTagName": "args", "FieldFullType": {"Str": "Map", "Domain": {"Str": "string"}, "Range": {"Str": "string"}}}]}}}
    struct = tx.schema_struct(full, "LogEntry")
    assert struct.simpleString() == "struct<lsn:bigint,op:string,args:map<string,string>>"
    got = f.select(F.from_json(tx.schema_to_json(full)("payload"), struct).alias("j")).select("j.*").orderBy("op").collect()
    assert [(r.lsn, r.op, r.args) for r in got] == [(None, "0x0", None), (1, "0x1", None), (2, "0x2", None)]


def test_msgpack_frames(spark):
    d = spark.createDataFrame([(8, "x", 1.5, [1, 2])], "t long, a string, b double, c array<int>")
    r = ff.to_msgpack_frames(d, "t", ["a", "b", "c"]).select("evtnum", tx.msgpack_to_json("payload").alias("j")).collect()[0]
    assert r.evtnum == 9 and json.loads(r.j) == {"a": "x", "b": 1.5, "c": [1, 2]}


def test_index_files(spark, tmp_path):
    write_frames(gen.floats(spark, 200).orderBy("seq").coalesce(1), str(tmp_path))
    index = grouping.time_index(read_frames(spark, str(tmp_path)))
    out = grouping.write_indexes(index).where("path is not null").collect()
    entries = [row for row, _ in codec.walk(open(out[0].path, "rb").read())]
    assert [(e["tm_ns"], e["v1"]) for e in entries] == [(r.tm_ns, r.byte_offset) for r in index.orderBy("seq").collect()]
    assert len(entries) == out[0].n == 4 and [e["v1"] // 16 for e in entries] == [0, 61, 121, 181]
    assert read_frames(spark, str(tmp_path)).count() == 200


@pytest.mark.parametrize("table", [True, False])
def test_display_numbers_across_sources(spark, table):
    f = gen.floats(spark, 2, "b").unionByName(gen.floats(spark, 2, "a"))
    lines = [r.value for r in tx.display(f, table=table).collect()]
    assert len(lines) == 4 and (table or [x[:6] for x in lines] == ["000001", "000002", "000003", "000004"])
