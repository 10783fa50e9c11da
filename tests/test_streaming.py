import pytest

from chronoframe.operators.dedup import mark_duplicates
from chronoframe.sources.frames import read_frames
from chronoframe.streaming import archive as ar
from chronoframe.streaming import dedup
from chronoframe.streaming.dedup import mark_duplicates_stream
from chronoframe.streaming.grouping import count_per_stream
from tests.makers import BASE, frame, frames_df

DAY = 86400 * 10**9


def test_archive(spark, tmp_path):
    rows = [("svc.archive.s.id1", "r1", frame(BASE, 2, 1.0)), ("svc.archive.s.id2", None, frame(BASE + DAY, 2, 2.0)), ("other.x", "r", b"12345678"), ("svc.archive.t", "r3", frame(BASE - DAY, 13, payload=b"late")), ("svc.archive.t", "r4", b"")]
    spark.createDataFrame(rows, "subject string, reply string, data binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject string, reply string, data binary").parquet(str(tmp_path / "in"))
    acks = []
    q = ar.archive(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "svc", lambda df, n: acks.extend(map(tuple, df.collect())), every=None)
    q.awaitTermination(120)
    got = sorted((r.year, r.month, r.day, r.stream, bytes(r.raw)) for r in ar.read_archive(spark, str(tmp_path / "out")).collect())
    assert got == sorted([("2016", "02", "16", "s", rows[0][2]), ("2016", "02", "17", "s", rows[1][2]), ("2016", "02", "15", "t", rows[3][2])])
    assert sorted(acks) == sorted([("r1", "id1"), ("svc.storage-ack.s", "id1"), ("r3", ""), ("svc.storage-ack.t", "")])
    days = ar.available_days(str(tmp_path / "out"))
    assert days == ["2016/02/15", "2016/02/16", "2016/02/17"]
    assert ar.intersect_days(days, "2016/02/15", "2016/02/17") == days[:2] and ar.intersect_days(days, "2016/02/16") == days[1:2]
    with pytest.raises(FileNotFoundError):
        ar.available_days(str(tmp_path / "nowhere"))


def test_archive_as_frame_files(spark, tmp_path):
    rows = [("svc.archive.s", None, frame(BASE + i * 8, 2, float(i))) for i in range(5)] + [("svc.archive.t", None, frame(BASE + DAY, 5))]
    spark.createDataFrame(rows, "subject string, reply string, data binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject string, reply string, data binary").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the same batch again, as after a failure
        ar.archive(stream, str(tmp_path / "out"), str(tmp_path / f"ck{_}"), "svc", every=None, layout="frames").awaitTermination(120)
    got = read_frames(spark, str(tmp_path / "out"), layout="day").orderBy("source_id", "seq").collect()
    assert [bytes(r.raw) for r in got] == [r[2] for r in rows]
    assert got[0].source_id.endswith("/2016/02/16/s/pack-00000") and ar.available_days(str(tmp_path / "out")) == ["2016/02/16", "2016/02/17"]
    assert read_frames(spark, str(tmp_path / "out"), layout="day").where(f"tm_ns >= {BASE + DAY}").count() == 1
    with pytest.raises(ValueError):
        ar.archive(stream, "x", "y", "svc", layout="other")


def test_replay_sends_once(spark):
    a = frames_df(spark, [("s", "a", frame(BASE + i * 8, 2, float(i))) for i in (0, 2, 4)])
    b = frames_df(spark, [("s", "b", frame(BASE + i * 8, 2, float(i))) for i in (1, 3)])
    out = ar.replay("x", a, b).collect()
    assert [bytes(r.data) for r in out] == [frame(BASE + i * 8, 2, float(i)) for i in range(5)]
    assert {r.subject for r in out} == {"tseries.replay.x.2016/02/16"}


def test_dedup_stream(spark, tmp_path):
    raws = [("s", "a", frame(BASE + (i * 7 % 5) * 8, 2, 0.0)) for i in range(40)] + [("s", "b", frame(BASE, 2, 0.0))]
    f = frames_df(spark, raws)
    expected = {(r.source_id, r.seq): r.is_dup for r in mark_duplicates(f, 6, by=["source_id"]).collect()}
    for k, part in enumerate((f.where("seq < 17"), f.where("seq >= 17"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = mark_duplicates_stream(stream, 6).writeStream.format("memory").queryName("marked").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert {(r.source_id, r.seq): r.is_dup for r in spark.sql("select * from marked").collect()} == expected
    finally:
        q.stop()


def test_dedup_stream_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "STRETCH", 16)
    calls = spark.sparkContext.accumulator(0)

    class Counted(dedup.WindowDedup):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(dedup, "WindowDedup", Counted)
    monkeypatch.setattr(dedup, "BUCKETS", 8)
    f = frames_df(spark, [("s", f"f{k}", frame(BASE + (i * i % 11) * 8, 2, 0.0)) for k in range(20) for i in range(60)])
    expected = {(r.source_id, r.seq): r.is_dup for r in mark_duplicates(f, 4, by=["source_id"]).collect()}
    assert len(set(expected.values())) == 2
    for k, part in enumerate((f.where("seq < 15"), f.where("seq >= 15 and seq < 33"), f.where("seq >= 33"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = mark_duplicates_stream(stream, 4).writeStream.format("memory").queryName("stretched").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        rows = spark.sql("select * from stretched").collect()
        assert len(rows) == len(expected) and {(r.source_id, r.seq): r.is_dup for r in rows} == expected
        assert 0 < calls.value <= 3 * 8  # a call per bucket and batch, not per frame
    finally:
        q.stop()


def test_count_stream(spark, tmp_path):
    f = frames_df(spark, [("s", "a", frame(BASE + i * 20 * 10**9, 2, 0.0)) for i in range(10)])
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    q = count_per_stream(stream, late=None).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert [r.n for r in spark.sql("select * from counted order by start").collect()] == [3, 3, 3, 1]
    finally:
        q.stop()
