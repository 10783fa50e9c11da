import json

import pytest
from pyspark.sql import functions as F

from chronoframe.functions import dates, paths
from chronoframe.functions import text as tx
from tests.makers import BASE, frame, frames_df

LOG_SCHEMA = {"Structs": {"LogEntry": {"Fields": [{"Zid": 0, "FieldTagName": "lsn"}, {"Zid": 1, "FieldTagName": "op"}, {"Zid": 2, "FieldTagName": "args"}]}}}


@pytest.mark.parametrize(
    "x,text",
    [(1.5, "1.5"), (100.0, "100"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-5, "1e-05"), (0.0001, "0.0001"), (-0.0, "-0"), (0.0, "0"), (123456.789, "123456.789"), (-2.5e-7, "-2.5e-07"), (float("nan"), "NaN"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (5e-324, "5e-324")],
)
def test_float_text(x, text):
    assert tx.float_text(x) == text


def test_time_text():
    assert tx.time_text(BASE) == "2016-02-16T00:00:00Z"
    assert tx.time_text(BASE + 8) == "2016-02-16T00:00:00.000000008Z"
    assert tx.time_text(BASE + 120_000_000) == "2016-02-16T00:00:00.12Z"
    assert tx.time_text(-8) == "1969-12-31T23:59:59.999999992Z"


def test_golden_line():
    payload = bytes.fromhex("82ffa84c6f67456e74727901a3307830")
    row = (BASE, 7, 16, 33, 17, None, None)
    number, word, rest = tx.display_line(row, payload, 0, schema=LOG_SCHEMA).split(" ", 2)
    assert (number, word, rest) == ("000000", tx.HEADER_WORD, "2016-02-16T00:00:00Z EVTNUM Ev.16 [33 bytes] (UCOUNT 17) {\"op\":\"0x0\"}")
    assert tx.display_line(row, payload, 0).endswith("(UCOUNT 17)")


def test_lines(spark):
    f = frames_df(spark, [("s", "a", frame(BASE, 3, 1.5, -4)), ("s", "a", frame(BASE, 14, payload=b'{"k":1}')), ("s", "a", frame(BASE, 9, payload=bytes.fromhex("82a162c3a16101"))), ("s", "a", frame(BASE, 5))])
    rows = f.select(tx.stringify().alias("t"), tx.stringify(F.col("seq") + 1, skip_payload=True).alias("h"), tx.stringify_table().alias("r")).collect()
    assert rows[0].t.split(" ", 1)[1] == "2016-02-16T00:00:00Z EVTNUM EvTwo64 [24 bytes] (UCOUNT 0) V0:1.5 V1:-4"
    assert rows[0].h.startswith(f"000001 {tx.HEADER_WORD} ")
    assert rows[0].r == "2016-02-16T00:00:00Z evtnum EvTwo64 V0 1.5 V1 -4"
    assert rows[1].t.endswith('(UCOUNT 8)  {"k":1}')
    assert rows[2].t.endswith('{"a":1,"b":true}') and rows[2].r.endswith(" '{\"a\":1,\"b\":true}'")
    assert rows[3].t.endswith("EVTNUM EvNA [8 bytes] (UCOUNT 0)")


def test_indent_keeps_tokens():
    text = '{"a":[1.50,{}, "x{\\"}"],"b":{"c":null}}'
    out = tx.indent_json(text)
    assert json.loads(out) == json.loads(text) and "1.50" in out and "\n          " in out
    assert tx.indent_json("{oops") == "{oops"


def test_msgpack_round_trip():
    for x in ({"a": [1, -1, 300, -300, 1 << 40, -(1 << 40)], "b": {"c": None, "d": True}, "e": 1.5, "f": "ü" * 40}, [], {}, list(range(70))):
        assert json.loads(tx.msgpack_json(tx.pack_msgpack(x))) == x
    assert tx.msgpack_json(b"\xc1") is None and tx.msgpack_json(None) is None


def test_msgpack_binaries_and_times():
    text = lambda b: tx.msgpack_json(b)
    assert text(b"\xc4\x02ab") == '"ab"' and text(b"\xc4\x01\xff") == '"\ufffd"'
    assert text(b"\xd7\x01" + (1455580800000000000).to_bytes(8, "big")) == "1455580800000000000"
    assert text(b"\xc7\x09\x01\xd3" + (-5).to_bytes(8, "big", signed=True)) == "-5"
    assert text(b"\xd6\xff\x00\x00\x00\x07") == "7000000000" and text(b"\xd7\xff" + ((3 << 34) | 2).to_bytes(8, "big")) == "2000000003"
    assert text(b"\xc7\x0c\xff\x00\x00\x00\x05" + (-1).to_bytes(8, "big", signed=True)) == "-999999995"
    assert text(b"\xd5\x07hi") == '"hi"' and text(b"\x81\xa1x\xcb\x7f\xf8\x00\x00\x00\x00\x00\x00") == '{"x":null}'


def test_columns_equal_the_plain_lines(spark):
    """Lines made from columns, and those of one row at a time."""
    raws = [frame(t, e, v, w, p) for t in (BASE, BASE + 8, -8, -(10**18), 120_000_000) for e, v, w, p in ((0, 0, 0, None), (1, 0, -7, None), (2, 1e21, 0, None), (3, float("-inf"), 5, None), (2, float("nan"), 0, None), (14, 0, 0, b'{"k":\xff1}'), (9, 0, 0, b"\x81\xa1a\x01"), (9, 0, 0, b"\xc1"), (2005, 0, 0, None), (-3, 0, 0, b"x"))]
    rows = frames_df(spark, [("s", "a", r) for r in raws]).select("*", tx.stringify(F.col("seq")).alias("line"), tx.stringify_table().alias("table")).collect()
    for r in rows:
        p = bytes(r.payload) if r.payload is not None else None
        assert r.line == tx.display_line((r.tm_ns, r.pti, r.evtnum, r.nbytes, r.ucount, r.v0, r.v1), p, r.seq)
        assert r.table == tx.table_line(r.tm_ns, r.pti, r.evtnum, r.v0, r.v1, p)


def test_dates(spark):
    texts = ["2016/02/25", "2016/2/5", "2016/02/31", "1969/01/01", "3001/01/01", "2016/13/01", "2016/00/10", "x", None, "2016-02-25"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dates.date_text(dates.parse_date(F.col("t")))).collect()]
    assert got == ["2016/02/25", "2016/02/05", "2016/03/02", None, None, None, None, None, None, None]
    before = spark.range(1).select(dates.date_text(dates.date_of_ns(F.lit(-1)))).collect()[0][0]
    assert before == "1969/12/31"


def test_paths(spark):
    subjects = ["svc.archive.mystream", "svc.archive.my-stream", "svc.archive.123.456.789-10", "svc.archive.", "svc.archive", "wrong.blah.hello."]
    got = spark.createDataFrame([(t,) for t in subjects], "t string").select(paths.subject_stream(F.col("t"), "svc"), paths.subject_id(F.col("t"), "svc")).collect()
    assert [tuple(r) for r in got] == [("mystream", ""), ("my-stream", ""), ("123", "456.789-10"), ("", ""), ("", ""), ("", "")]
    names = ["2016", "01", "31", "1999", "41", "00", "3x", "201"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in names], "t string").select(paths.is_date_dir(F.col("t"))).collect()] == [True] * 3 + [False] * 5
    r = spark.range(1).select(paths.xtra_dirs(F.lit("abcd")), paths.xtra_dirs(F.lit("ab")), paths.chomp_slash(F.lit("/a/b/")), paths.archive_path("/r/", F.lit(BASE), F.lit("s"))).collect()[0]
    assert tuple(r) == ("a/b/c/abcd/", None, "/a/b", "/r/2016/02/16/s")
