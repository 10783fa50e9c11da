import random
import time
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from chronoframe import codec
from chronoframe.files import folder_name
from chronoframe.operators import compaction as cp
from chronoframe.operators.blobs import BrokenFile, Joiner, crc32_combine, zstd_frames
from tests.makers import BASE, frame, frames_df

DAY = 86400 * 10**9


def _files(spark, ids):
    return spark.createDataFrame([(i, p, "x") for p, i in ids.items()], "file_id long, path string, stream_name string")


def _brute(raws, ids, limit):
    files = {}
    for stream, source, raw in raws:
        files.setdefault((source, stream, (int.from_bytes(raw[:8], "little", signed=True) & ~7) // DAY), []).append(raw)
    out = set()
    for (s, stream, day), own in files.items():
        peers = {k[0]: set(v) for k, v in files.items() if k[1:] == (stream, day)}
        if sum(map(len, own)) >= limit or len(peers) < 2:
            continue
        mine = set(own)
        if not any(p != s and mine <= r and (len(r) > len(mine) or ids[p] < ids[s]) for p, r in peers.items()):
            out.add((ids[s], stream))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ledger_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(cp, "CHUNK_FRAMES", 8)  # files of several pieces
    rng = random.Random(seed)
    raws = []
    for k in range(25):
        stream, day = rng.choice("ab"), rng.randrange(2)
        own = [frame(BASE + day * DAY + rng.randrange(12) * 8, 2, 1.0) for _ in range(rng.choice([1, 2, 3, 20]))]
        raws += [(stream, f"f{k}", r) for r in own]
        if rng.random() < 0.4:
            raws += [(stream, f"copy{k}", r) for r in rng.sample(own, rng.randint(1, len(own)))]
    names = sorted({r[1] for r in raws})
    ids = {n: i for n, i in zip(names, rng.sample(range(1000), len(names)))}
    f = frames_df(spark, raws).withColumn("extra", F.lit(1)).withColumn("day", F.lit("x"))
    manifest = cp.fold_frames(f.repartition(3) if seed == 2 else f, _files(spark, ids), limit=200)
    rows = cp.folded_files(manifest).collect()
    assert {(r.file_id, r.stream_name) for r in rows} == _brute(raws, ids, 200)
    assert len(rows) == len({r.file_id for r in rows})
    _holds_all(manifest, raws)


def _holds_all(manifest, raws):
    """Every distinct frame of a stream's day lies in its packs once, at the stated lengths and checksums."""
    got = {}
    for m in cp.packs(manifest).collect():
        data = open(m.path.removeprefix("file:"), "rb").read()
        assert (m.n_bytes, m.crc32) == (len(data), zlib.crc32(data))
        here = [row["raw"] for row, _ in codec.walk(data)]
        assert m.n_frames == len(here)
        got.setdefault((m.stream_name, m.file_day), []).extend(here)
    want = {}
    for stream, _, raw in raws:
        want.setdefault((stream, time.strftime("%Y/%m/%d", time.gmtime((int.from_bytes(raw[:8], "little") & ~7) // 10**9))), set()).add(raw)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_nulls_repeats_and_empty(spark):
    raws = [("s", "a", frame(BASE)), ("s", "b", frame(BASE + 8)), (None, "c", frame(BASE)), (None, "d", frame(BASE + 8))]
    f = frames_df(spark, raws)
    more = f.unionByName(f.limit(2).withColumn("source_id", F.lit(None).cast("string"))).unionByName(f.limit(1).withColumn("raw", F.lit(None).cast("binary"))).unionByName(f.limit(1).withColumn("seq", F.lit(None).cast("long")))
    for table in (more, more.unionByName(f)):
        manifest = cp.fold_frames(table, _files(spark, {"a": 1, "b": 2, "c": 3}))
        assert {(r.source_id, r.stream_name, r.file_id) for r in manifest.where("fold").collect()} == {("a", "s", 1), ("b", "s", 2), ("c", None, 3), ("d", None, None)}
        _holds_all(manifest, raws)
    assert cp.fold_frames(f.where("false"), _files(spark, {"a": 1})).count() == 0


def test_streams_keep_their_folders(spark, tmp_path):
    names = ["a/b", "a_b", "_", "%", "a%2Fb", "", "..", None, "x" * 300, "\u00fc"]
    raws = [(n, f"{i}{k}", frame(BASE + 16 * i + 8 * k, 2, 1.0)) for i, n in enumerate(names) for k in range(2)]
    manifest = cp.fold_frames(frames_df(spark, raws), _files(spark, {}), str(tmp_path / "out"))
    _holds_all(manifest, raws)
    assert cp.packs(manifest).select("path").distinct().count() == len(names) == len({folder_name(n) for n in names})
    with pytest.raises(FileExistsError):
        cp.fold_frames(frames_df(spark, raws), _files(spark, {}), str(tmp_path / "out"))


def test_large_files_and_packs(spark, tmp_path, monkeypatch):
    """Files of several chunks and segments, frames held by large and small ones, packs of about the stated size."""
    monkeypatch.setattr(cp, "CHUNK_FRAMES", 16)
    monkeypatch.setattr(cp, "SEGMENT_BYTES", 200)
    monkeypatch.setattr(cp, "BLOCK_KEYS", 50)
    rng = random.Random(2)
    raws = [(rng.choice("ab"), f"f{rng.randrange(9)}", frame(BASE + rng.randrange(300) * 8, 13, payload=bytes([rng.randrange(3)]) * rng.randrange(30))) for _ in range(500)]
    raws = [(s, f"{s}{f}", r) for s, f, r in raws]
    raws += [("a", "small", raws[k][2]) for k in range(500) if raws[k][:2] == ("a", "af0")][:3]
    manifest = cp.fold_frames(frames_df(spark, raws), _files(spark, {"small": 1}), str(tmp_path / "out"), limit=150, pack_bytes=2000)
    _holds_all(manifest, raws)
    assert manifest.where("fold").count() == 0 and cp.packs(manifest).count() > 4
    assert manifest.where("source_id is not null").agg(F.sum("n_in"), F.sum("n_out")).collect()[0] == (len(raws), cp.packs(manifest).agg(F.sum("n_frames")).collect()[0][0])


def test_long_files_leave_in_small_rows():
    """However long a stretch of a file is, a row of it stays small; lengths and checksums add up."""
    import pyarrow as pa

    raws = [frame(BASE + 8 * k, 2, float(k % 50)) for k in range(9000)]
    n = len(raws)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array(["s"] * n), pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array([16] * n, pa.int32()), pa.array(raws), pa.array([r for r in raws])], ["source_id", "stream_name", "day", "chunk", "seq", "nbytes", "raw", "key"])
    rows = [r for b in cp._segments(cp.SMALL_FILE_BYTES)(iter([batch.slice(0, 5000), batch.slice(5000)])) for r in b.to_pylist()]
    keys = sorted((r for r in rows if r["kind"] == cp.KEYS), key=lambda r: r["first_seq"])
    assert len(keys) == 5 and max(r["n_read"] for r in keys) <= cp.SEGMENT_BYTES and sum(r["n"] for r in keys) == n
    crc = 0
    for r in keys:
        crc = crc32_combine(crc, r["crc"], r["n_read"]) if r["first_seq"] else r["crc"]
    assert crc == zlib.crc32(b"".join(raws))


def test_damage_is_seen(spark, tmp_path, monkeypatch):
    f = frames_df(spark, [("s", "a", frame(BASE)), ("s", "b", frame(BASE + 8, 2, 1.0))])
    monkeypatch.setattr(cp, "crc32_combine", lambda *a: 7)
    cp.fold_frames(f, _files(spark, {}), str(tmp_path / "one"))  # single segments need no combining
    pieces = cp.file_pieces(f, _files(spark, {})).withColumn("crc", F.col("crc") + 1)
    monkeypatch.setattr(cp, "file_pieces", lambda *a: pieces)
    with pytest.raises(Exception, match="BrokenFile|checksum"):
        cp.fold_frames(f, _files(spark, {}), str(tmp_path / "two"))


def test_crc_of_joined_pieces():
    rng = random.Random(5)
    for n in (0, 1, 2, 9, 1000, 70000):
        a, b = rng.randbytes(n * 3 % 71), rng.randbytes(n)
        assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_lines_and_headers():
    j = Joiner("lines", header=True)
    out = b"".join(j.add(x) for x in (b"\xef\xbb\xbfh1,h2\n1,2\n", b"", b"h1,h2\r\n3,4", b"h1,h2\n"))
    assert out == b"h1,h2\n1,2\n3,4\n"
    j.check()
    with pytest.raises(BrokenFile, match="header"):
        j.add(b"other\n5")
    j = Joiner("lines")
    assert j.add(b"a") + j.add(b"b\n") == b"a\nb\n"
    j.check()


def test_zstd():
    parts = [zstandard.ZstdCompressor(write_checksum=c, write_content_size=s).compress(d) for c, s, d in ((True, True, b"a" * 1000), (False, False, b""), (True, False, bytes(range(256)) * 2000))]
    skip = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    assert [zstd_frames(p) for p in parts] == [1, 1, 1] and zstd_frames(parts[0] + skip + parts[2]) == 2
    for broken in (parts[2][:-1], parts[0][:5], b"xxxx", parts[0] + b"\x28"):
        with pytest.raises(BrokenFile):
            zstd_frames(broken)
    j = Joiner("zstd")
    out = b"".join(map(j.add, parts))
    assert zstandard.ZstdDecompressor().stream_reader(out, read_across_frames=True).read() == b"a" * 1000 + bytes(range(256)) * 2000


def test_pack_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(20):
        (tmp_path / f"in/{k:02d}.csv").write_text(f"id\n{k}" + ("\n" if k % 2 else ""))
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    out = cp.pack_files(files, F.lit("g"), str(tmp_path / "out"), header=True, pack_bytes=30).collect()
    lines = [x for r in sorted(out, key=lambda r: r.pack) for x in open(r.path).read().split("\n") if x and x != "id"]
    assert sorted(map(int, lines)) == list(range(20)) and len(out) < 20 and sum(r.n_files for r in out) == 20
    assert cp.pack_files(files.where("false"), F.lit("g"), str(tmp_path / "none")).count() == 0
