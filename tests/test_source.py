import os

import pytest
from pyspark.sql import functions as F

from chronoframe.sources import frames as src
from chronoframe.streaming.archive import follow
from tests.makers import BASE, frame


def _write(path, raws, cut=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = b"".join(raws)
    with open(path, "wb") as f:
        f.write(data[: len(data) - cut])


def _raws(n):
    return [frame(BASE + i * 8, (2, 13, 3, 0)[i % 4], float(i), i, b"x" * (i % 50) if i % 4 == 1 else None) for i in range(n)]


def test_read_write(spark, tmp_path):
    raws = _raws(100)
    _write(str(tmp_path / "in/a"), raws[:60])
    _write(str(tmp_path / "in/sub/b"), raws[60:], cut=3)
    _write(str(tmp_path / "in/.hidden"), raws)
    df = src.read_frames(spark, str(tmp_path / "in"))
    rows = df.orderBy("source_id", "seq").collect()
    assert [bytes(r.raw) for r in rows] == raws[:99]
    assert [r.byte_offset for r in rows[:3]] == [0, 16, 16 + len(raws[1])]
    src.write_frames(df.orderBy("tm_ns").coalesce(1), str(tmp_path / "out"))
    again = src.read_frames(spark, str(tmp_path / "out"), ["seq", "raw"])
    assert again.columns == ["seq", "raw"] and [bytes(r.raw) for r in again.orderBy("seq").collect()] == raws[:99]
    src.write_frames(df.limit(5), str(tmp_path / "out"), "overwrite")
    assert src.read_frames(spark, str(tmp_path / "out")).count() == 5
    with pytest.raises(Exception, match="TooShort|second word|needed"):
        src.read_frames(spark, str(tmp_path / "in"), mode="FAILFAST").count()
    with pytest.raises(Exception, match="allowed"):
        src.read_frames(spark, str(tmp_path / "in"), max_frame_bytes=20).count()


def test_split_and_filters(spark, tmp_path):
    raws = _raws(500)
    _write(str(tmp_path / "2016/02/16/s"), raws)
    _write(str(tmp_path / "2016/02/17/s"), [frame(BASE + 86400 * 10**9, 2, 1.0)])
    df = src.read_frames(spark, str(tmp_path), split_bytes=1000)
    assert df.rdd.getNumPartitions() > 5
    assert [(x.seq, bytes(x.raw)) for x in df.where("tm_ns < 1455667200000000000").orderBy("seq").collect()] == list(enumerate(raws))
    pruned = src.read_frames(spark, str(tmp_path), layout="day").where(F.col("tm_ns") >= BASE + 86400 * 10**9)
    assert pruned.count() == 1
    one = src.read_frames(spark, str(tmp_path)).where(F.col("source_id") == str(tmp_path / "2016/02/17/s"))
    assert one.count() == 1
    assert src.read_frames(spark, str(tmp_path)).where("source_id = 'nowhere'").count() == 0


def test_pieces_of_many_files_share_tasks(spark, tmp_path):
    raws = _raws(100)
    for k in range(60):
        _write(str(tmp_path / f"in/{k:02d}"), raws)
    df = src.read_frames(spark, str(tmp_path / "in"), ["source_id", "seq", "byte_offset", "raw"], split_bytes=500)
    most = 4 * spark.sparkContext.defaultParallelism + 1
    splits = src.split_points(spark, src.file_sizes(str(tmp_path / "in")), 500)
    assert len(splits) == 60 and min(map(len, splits.values())) > 3
    assert 4 < df.rdd.getNumPartitions() <= most
    places = [sum(map(len, raws[:i])) for i in range(100)]
    rows = df.orderBy("source_id", "seq").collect()
    assert [(r.source_id[-2:], r.seq, r.byte_offset, bytes(r.raw)) for r in rows] == [(f"{k:02d}", i, places[i], raws[i]) for k in range(60) for i in range(100)]


def test_percent_signs_in_uris(spark, tmp_path):
    raws = _raws(100)
    _write(str(tmp_path / "in/a%2Fb"), raws)
    path = f"file://{tmp_path}/in"
    rows = src.read_frames(spark, path, ["source_id", "raw"], split_bytes=500).collect()
    assert {r.source_id for r in rows} == {f"{path}/a%2Fb"} and sorted(bytes(r.raw) for r in rows) == sorted(raws)


def test_follow(spark, tmp_path):
    path = str(tmp_path / "in/a")
    raws = _raws(40)
    _write(path, raws[:10])
    q = follow(spark, str(tmp_path / "in"), "end").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        _write(path, raws[:20], cut=2)
        q.processAllAvailable()
        got = spark.sql("select seq from followed order by seq").collect()
        assert [r.seq for r in got] == list(range(10, 19))
        _write(path, raws)
        q.processAllAvailable()
        got = spark.sql("select seq, raw from followed order by seq").collect()
        assert [(r.seq, bytes(r.raw)) for r in got] == [(i, raws[i]) for i in range(10, 40)]
    finally:
        q.stop()


def test_offsets_of_many_files_stay_small(spark, tmp_path):
    raws = _raws(40)
    for k in range(1100):
        _write(str(tmp_path / f"in/f{k:04d}"), raws[:3])

    def follow_once():
        q = follow(spark, str(tmp_path / "in"), "begin", ["source_id", "seq", "raw"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(len(p["sources"][0]["endOffset"]) for p in q.recentProgress)

    assert follow_once() < 1000
    for k in range(5):
        _write(str(tmp_path / f"in/f{k:04d}"), raws, cut=1)
    _write(str(tmp_path / "in/new"), raws[:7])
    assert follow_once() < 1000  # a new reader
    got = sorted((r.source_id[-5:], r.seq, bytes(r.raw)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    expected = [(f"f{k:04d}", i, raws[i]) for k in range(1100) for i in range(39 if k < 5 else 3)] + [("n/new", i, raws[i]) for i in range(7)]
    assert got == sorted(expected)


def test_ledger_steps(tmp_path):
    for k in range(5):
        _write(str(tmp_path / f"in/{k}"), _raws(4))
    reader = src.FollowReader(src.FRAME_SCHEMA, {"path": str(tmp_path / "in"), "ledgerfiles": "2"})
    first = reader.latestOffset()
    assert list(first) == [""] and reader.latestOffset() == first
    for k in (1, 4, 7):
        _write(str(tmp_path / f"in/{k}"), _raws(6), cut=1)
    second = reader.latestOffset()
    grown = lambda r: sorted((p[-1], seq) for piece in r.partitions(first, second) for p, _, _, seq in piece.parts)
    assert grown(reader) == [("1", 4), ("4", 4), ("7", 0)]
    assert grown(src.FollowReader(src.FRAME_SCHEMA, {"path": str(tmp_path / "in"), "ledgerfiles": "2"})) == grown(reader)
    for k, inline in enumerate(("2", "100")):  # restarted with a batch that was planned: nothing is new
        options = {"path": str(tmp_path / "in"), "ledgerfiles": inline}
        planned, again = src.FollowReader(src.FRAME_SCHEMA, options).latestOffset(), src.FollowReader(src.FRAME_SCHEMA, options)
        assert len(again.partitions({}, planned)[0].parts) == 6 + k and again.latestOffset() == planned
        _write(str(tmp_path / f"in/new{k}"), _raws(2))
        assert [(p[-4:], n) for piece in again.partitions(planned, again.latestOffset()) for p, n, *_ in piece.parts] == [(f"new{k}", 0)]
    reader.commit(second)
    kept = [f.name for f in (tmp_path / "in/.followed").iterdir() if f.name.startswith(reader.ident)]
    assert kept == [second[""].rpartition("/")[2]] and len(list(reader.partitions({}, second)[0].parts)) == 6


def test_lines(spark, tmp_path):
    (tmp_path / "p").write_text("a\n\nb\nlast")
    assert [r.value for r in src.read_lines(spark, str(tmp_path / "p")).collect()] == ["a", "b", "last"]
    assert src.read_patterns(str(tmp_path / "p")) == ["a", "b", "last"]
