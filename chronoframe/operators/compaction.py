"""Consolidating far too many small files by joining their bytes.

`fold_frames` joins the files of each stream's UTC day into packs that hold every distinct frame once: whole files one
after the other, less the byte ranges of frames that another file holds. `pack_files` joins whole files of lines or
zstandard frames. Records are moved as bytes (`blobs`), never re-encoded; lengths and checksums of what goes in and
of what was written are compared.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.files import Output, attempt_name, folder_name, is_empty
from chronoframe.functions.times import day_text, utc_day, whole_div
from chronoframe.operators.arrow import bounds, spans
from chronoframe.operators.blobs import BrokenFile, Joiner, crc32_combine
from chronoframe.session import broadcast_if_small, cut_lineage, scratch_path, small_enough

SMALL_FILE_BYTES = 16_384
PACK_BYTES = 128 << 20
#: A file's frames are handled in chunks of so many, a chunk in segments of about so many bytes: what a row holds, so that
#: a batch of rows fits in memory.
CHUNK_FRAMES = 1 << 16
SEGMENT_BYTES = 1 << 15
BATCH_BYTES = 4 << 20
#: Identities a task looks through at once for repeats, before they are shuffled.
BLOCK_KEYS = 1 << 19
SMALL_SIDE = 200_000
NO_STREAM = "\x01"  # stands for a null stream, so that joins meet it
LARGE = (1 << 31) - 1
UNLISTED = 1 << 62

_T = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> tuple[str, list[str], list[pa.DataType]]:
    names, kinds = zip(*(c.split(" ") for c in text.split(", ")))
    return text, list(names), [_T[k] for k in kinds]


_SEGMENT, _SEGMENT_NAMES, _SEGMENT_TYPES = _schema("source_id string, stream_name string, day long, kind int, chunk long, first_seq long, n long, n_bytes long, n_read long, crc long, n_keys int, keys binary, seqs binary, own binary, file_id long, route long")
_PIECE, _PIECE_NAMES, _PIECE_TYPES = _schema("source_id string, stream_name string, day long, kind int, file_id long, rank long, weight int, chunk long, first boolean, n long, n_bytes long, n_read long, crc long, file_bytes long, keys binary, seqs binary, own binary")
_KEY, _KEY_NAMES, _KEY_TYPES = _schema("k1 long, k2 long, weight int, rank long, seq long, holder long")
_DATA, _DATA_NAMES, _DATA_TYPES = _schema("source_id string, stream_name string, day long, chunk long, first_seq long, sizes binary, data binary")
_MANIFEST, _MANIFEST_NAMES, _MANIFEST_TYPES = _schema("source_id string, stream_name string, day long, pack long, first boolean, file_id long, small boolean, at long, n_in long, n_out long, bytes_in long, bytes_out long, crc32 long, path string")
LISTED, SEEN, KEYS = 0, 1, 2  # kinds of segments: catalogue row, totals of a large one, one with its identities


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
    rows.clear()
    return batch


def _stored(frames: DataFrame) -> DataFrame:
    """The frames that belong to a file, with their day and chunk."""
    f = frames.where("source_id is not null and seq is not null and tm_ns is not null and raw is not null")
    stream = F.coalesce("stream_name", F.lit(NO_STREAM)).alias("stream_name")
    return f.select("source_id", stream, utc_day(F.col("tm_ns")).alias("day"), whole_div(F.col("seq"), CHUNK_FRAMES).alias("chunk"), "seq", F.coalesce("nbytes", F.octet_length("raw")).alias("nbytes"), "raw")


def _identity() -> Column:
    """A 128-bit identity of (stream, day, raw)."""
    place = F.encode(F.concat(F.lit("\x00"), "stream_name", F.lit("\x00"), F.col("day").cast("string")), "UTF-8")
    return F.unhex(F.md5(F.concat("raw", place)))


_FILE = ["source_id", "stream_name", "day", "chunk"]


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, dict]]:
    """Rows of one file, day and chunk whose seqs follow each other: (start, end, head)."""
    seq = batch.column("seq").to_numpy()
    edges = np.union1d(bounds(batch, _FILE), np.flatnonzero(np.diff(seq) != 1) + 1)
    heads = batch.select(_FILE).take(pa.array(edges[:-1])).to_pylist()
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), heads)


def _segments(limit: int):
    """Kernel over frames as they are stored: a row per stretch of a file, with length, checksum and identities. Nothing
    is sorted or shuffled; frames of one file that lie apart only make more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: tuple | None = None  # the last stretch, which the next batch may continue

        def close() -> None:
            nonlocal held
            if held is None:
                return
            head, first, n, stated, read, crc, keys, seqs = held
            at: dict[bytes, int] = {}
            for k, s in zip(keys, seqs):
                at.setdefault(k, s)
            own = sorted(set(seqs) - set(at.values())) if len(at) < n else []
            blob, places = b"".join(at), np.array(list(at.values()), np.int64).tobytes()
            big = stated >= limit
            place = (head["source_id"], head["stream_name"], head["day"])
            total = (head["chunk"], first, n, stated, read, crc)
            if big:
                rows.append((*place, SEEN, *total, None, None, None, None, None, None))
            rows.append((*place, KEYS, *total, len(at), blob, places, np.array(own, np.int64).tobytes(), None, first if big else None))
            held = None

        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = spans(batch.column("raw"))
            seq, keys = batch.column("seq").to_pylist(), batch.column("key").to_pylist()
            sizes = np.append(0, batch.column("nbytes").to_numpy().cumsum(dtype=np.int64)).tolist()
            for s, e, head in _stretches(batch):
                while s < e:
                    if held is not None and (head != held[0] or held[7][-1] + 1 != seq[s] or held[3] >= SEGMENT_BYTES):
                        close()
                    if held is None:
                        held = (head, seq[s], 0, 0, 0, 0, [], [])
                    _, first, n, stated, read, crc, k, q = held
                    upto = min(e, bisect.bisect_left(sizes, sizes[s] + SEGMENT_BYTES - stated, s + 1, e))
                    k.extend(keys[s:upto])
                    q.extend(seq[s:upto])
                    held = (head, first, n + upto - s, stated + sizes[upto] - sizes[s], read + at[upto] - at[s], zlib.crc32(data[at[s] : at[upto]], crc), k, q)
                    s = upto
            if len(rows) >= 2000:
                yield _rows(rows, _SEGMENT_NAMES, _SEGMENT_TYPES)
        close()
        yield _rows(rows, _SEGMENT_NAMES, _SEGMENT_TYPES)

    return run


def _unlisted(source: str) -> int:
    """Rank of a large file, and of one the catalogue does not know: past every listed small one."""
    import hashlib

    return UNLISTED | int.from_bytes(hashlib.blake2b(source.encode(), digest_size=8).digest(), "big") >> 3


class _File:
    """One file's day while its segments go by. Segments of a large file leave as they come, those of a small one are
    joined: at most ``limit`` bytes of frames are held."""

    def __init__(self, source: str, stream: str, day: int, file_id: int | None, limit: int) -> None:
        self.place, self.file_id, self.limit = (source, stream, day), file_id, limit
        self.bytes, self.chunks, self.parts = 0, {}, []
        self.rank = file_id if file_id is not None and 0 <= file_id < UNLISTED else _unlisted(source)

    def add(self, r: dict, out: list[tuple]) -> None:
        """A later segment of seqs that were seen is the same rows once more."""
        if r["kind"] == SEEN or r["route"] is None:
            total = (r["first_seq"], r["n"], r["n_bytes"], r["n_read"], r["crc"])
            spots = self.chunks.setdefault(r["chunk"], {})
            if spots.setdefault(r["first_seq"], total) is not total:
                return
            self.bytes += r["n_bytes"]
        if r["kind"] == KEYS:
            self.parts.append(r)
        if self.bytes >= self.limit:
            self.rank = _unlisted(self.place[0])
            for p in self.parts:
                out.append(self._keys(p["chunk"], LARGE, p["keys"], p["seqs"], p["own"]))
            self.parts = []

    def _keys(self, chunk: int, weight: int, keys: bytes, seqs: bytes, own: bytes) -> tuple:
        return (*self.place, KEYS, self.file_id, self.rank, weight, chunk, None, None, None, None, None, None, keys, seqs, own)

    def close(self, out: list[tuple]) -> None:
        weight = LARGE
        if self.bytes < self.limit:
            at: dict[bytes, int] = {}
            own: list[int] = []
            for p in self.parts:
                own.extend(np.frombuffer(p["own"], np.int64).tolist())
                for i, s in enumerate(np.frombuffer(p["seqs"], np.int64).tolist()):
                    if at.setdefault(p["keys"][16 * i : 16 * i + 16], s) != s:
                        own.append(s)
            weight = len(at)
            out.append(self._keys(0, weight, b"".join(at), np.array(list(at.values()), np.int64).tobytes(), np.array(sorted(set(own)), np.int64).tobytes()))
        first = True
        for chunk, spots in sorted(self.chunks.items()):
            n, stated, read, crc, upto = 0, 0, 0, 0, 0
            for f, k, b, r, c in sorted(spots.values()):
                if n and f < upto:  # rows once more, cut elsewhere: what is read cannot be compared
                    read = crc = None
                n, stated, upto = n + max(0, f + k - max(f, upto)) if n else k, stated + b, max(upto, f + k)
                if read is not None:
                    crc, read = crc32_combine(crc, c, r), read + r
            out.append((*self.place, SEEN, self.file_id, self.rank, weight, chunk, first, n, stated, read, crc, self.bytes, None, None, None))
            first = False


def _files(limit: int):
    """Kernel over segments sorted by file: per chunk of a file its totals, and its identities with the file's rank and
    weight (distinct frames; all large files weigh the same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        file, listed = None, (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == LISTED:
                    if r["source_id"] != listed[0]:
                        listed = (r["source_id"], r["file_id"])
                    continue
                if r["route"] is not None:  # of a large segment, on its own
                    lone = _File(r["source_id"], r["stream_name"], r["day"], None, 0)
                    lone.add(r, out)
                    continue
                place = (r["source_id"], r["stream_name"], r["day"])
                if file is None or file.place != place:
                    if file is not None:
                        file.close(out)
                    file = _File(*place, listed[1] if listed[0] == r["source_id"] else None, limit)
                file.add(r, out)
            if len(out) >= 2000:
                yield _rows(out, _PIECE_NAMES, _PIECE_TYPES)
        if file is not None:
            file.close(out)
        yield _rows(out, _PIECE_NAMES, _PIECE_TYPES)

    return run


def file_pieces(frames: DataFrame, files: DataFrame, limit: int = SMALL_FILE_BYTES) -> DataFrame:
    """Per file, UTC day and chunk: totals and checksum (``kind`` 1), and identities with their seqs (``kind`` 2).
    Identities are shuffled once, as blobs by file; those of large segments are spread by place. The catalogue's
    file_id comes along in the same shuffle. Written to the shared folder."""
    segments = _stored(frames).withColumn("key", _identity()).mapInArrow(_segments(limit), _SEGMENT)
    null = lambda t: F.lit(None).cast(t)
    listed = files.where("path is not null and file_id is not null").groupBy(F.col("path").alias("source_id")).agg(F.min("file_id").cast("long").alias("file_id"))
    listed = listed.groupBy("file_id").agg(F.min("source_id").alias("source_id"))
    given = {"source_id": F.col("source_id"), "kind": F.lit(LISTED), "file_id": F.col("file_id")}
    listed = listed.select(*(given.get(c, null(t)).alias(c) for c, t in (x.split(" ") for x in _SEGMENT.split(", "))))
    spread = segments.unionByName(listed).repartition("source_id", "route")
    pieces = spread.sortWithinPartitions("source_id", "route", "stream_name", "day", "kind", "first_seq").mapInArrow(_files(limit), _PIECE)
    return cut_lineage(pieces)


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: a row per identity; of those a block holds several times only the one that ranks first is left to be
    compared, the others already name their ``holder``. So what very many files share is combined before the shuffle."""
    held: list[tuple] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        k = np.concatenate([np.frombuffer(b[0], ">i8").astype(np.int64).reshape(-1, 2) for b in held])
        count = [len(b[1]) // 8 for b in held]
        weight, rank = (np.repeat(np.array([b[i] for b in held], np.int64), count) for i in (2, 3))
        seq = np.concatenate([np.frombuffer(b[1], np.int64) for b in held])
        order = np.lexsort((seq, rank, -weight, k[:, 1], k[:, 0]))
        k, weight, rank, seq = k[order], weight[order], rank[order], seq[order]
        new = np.append(True, (k[1:] != k[:-1]).any(axis=1))
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        own_count = [len(b[4]) // 8 for b in held]
        own_rank = np.repeat(np.array([b[3] for b in held], np.int64), own_count)
        own_seq = np.concatenate([np.frombuffer(b[4], np.int64) for b in held])
        zero = np.zeros(len(own_seq), np.int64)
        held.clear()
        cols = [np.append(k[:, 0], zero), np.append(k[:, 1], zero), np.append(weight, zero), np.append(rank, own_rank), np.append(seq, own_seq)]
        holder = pa.array(np.append(rank[head], own_rank), mask=np.append(new, np.zeros(len(own_seq), bool)))
        table = pa.Table.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _KEY_TYPES)), holder], _KEY_NAMES)
        yield from table.to_batches(50_000)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("keys", "seqs", "weight", "rank", "own"))):
            held.append(row)
            n += len(row[1]) // 8
            if n >= BLOCK_KEYS:
                yield from flush()
                n = 0
    if held:
        yield from flush()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over identities sorted by (k1, k2, weight descending, rank, seq): the places that repeat an earlier one,
    with the rank of the file that holds it first. Constant memory, however many files hold a frame."""
    last = None
    for batch in batches:
        holder = batch.column("holder")
        k1, k2, rank, seq = (batch.column(c).to_numpy() for c in ("k1", "k2", "rank", "seq"))
        known = ~holder.is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~known)
        out_rank, out_seq, out_holder = [rank[known]], [seq[known]], [pc.drop_null(holder).to_numpy()]
        if len(at):
            a, b, r, s = k1[at], k2[at], rank[at], seq[at]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first_rank, first_seq = r.copy(), s.copy()
            if last is not None and last[:2] == (int(a[0]), int(b[0])):
                new[0], first_rank[0], first_seq[0] = False, last[2], last[3]
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            else:
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            first_rank, first_seq = first_rank[head], first_seq[head]
            last = (int(a[-1]), int(b[-1]), int(first_rank[-1]), int(first_seq[-1]))
            drop = ~new & ((r != first_rank) | (s != first_seq))
            out_rank.append(r[drop])
            out_seq.append(s[drop])
            out_holder.append(first_rank[drop])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_rank, out_seq, out_holder)], ["rank", "seq", "holder"])


def _contained(pieces: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Ranks of the ``doubtful`` files (every frame of theirs is held elsewhere, but first by several files) all of
    whose frames one other file of more distinct frames, or as many and a smaller rank, holds. Candidates meet at one
    identity, then at all; only equi-joins."""
    mine = pieces.where(f"kind = {KEYS}").join(doubtful, "rank", "left_semi")
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.frombuffer(b"".join(batch.column("keys").to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(batch.num_rows), [len(x) // 16 for x in batch.column("keys").to_pylist()])
            cols = [pa.array(k[:, 0]), pa.array(k[:, 1]), *(batch.column(c).take(pa.array(of)) for c in ("weight", "rank"))]
            table = pa.Table.from_arrays(cols, ["k1", "k2", "weight", "rank"])
            yield from table.to_batches(50_000)

    every = "k1 long, k2 long, weight int, rank long"
    wanted = cut_lineage(mine.select("keys", "weight", "rank").mapInArrow(spread, every))
    side = F.broadcast if small_enough(wanted, SMALL_SIDE) else (lambda df: df)
    held = pieces.where(f"kind = {KEYS}").select("keys", "weight", "rank").mapInArrow(spread, every).select("k1", "k2", F.col("weight").alias("w"), F.col("rank").alias("r"))
    held = cut_lineage(held.join(side(wanted.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi"))
    anchor = wanted.groupBy("rank").agg(F.min(F.struct("k1", "k2", "weight")).alias("a")).select("rank", "a.*")
    pairs = held.join(anchor, ["k1", "k2"]).where("w > weight or w = weight and r < rank").select("rank", "r").distinct()
    asked = pairs.join(wanted, "rank").select("rank", "r", "k1", "k2", "weight")
    met = asked.join(held.select("k1", "k2", "r").distinct(), ["k1", "k2", "r"]).groupBy("rank", "r").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    return met.where("n = weight").select("rank").distinct()


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over frames as they are stored: the bytes of each stretch of a file as one value, with the sizes of its
    frames."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = spans(batch.column("raw"))
        seq = batch.column("seq").to_pylist()
        size = np.diff(np.array(at, np.int64))
        for s, e, head in _stretches(batch):
            while s < e:
                upto = max(s + 1, int(np.searchsorted(at[s : e + 1], at[s] + SEGMENT_BYTES, side="right")) - 1 + s)
                upto = min(upto, e)
                rows.append((*head.values(), seq[s], size[s:upto].tobytes(), bytes(data[at[s] : at[upto]])))
                held += at[upto] - at[s]
                s = upto
                if held >= BATCH_BYTES or len(rows) >= 5000:
                    yield _rows(rows, _DATA_NAMES, _DATA_TYPES)
                    held = 0
    yield _rows(rows, _DATA_NAMES, _DATA_TYPES)


def _joiner(out_dir: str):
    """Kernel over rows sorted by (stream, day, pack, source, chunk, what, first_seq): a row of what is stated about a
    chunk, then its bytes. Appends the bytes, less the frames it is told another file holds; compares length and
    checksum of every chunk with the stated ones and, after reading it again, of every pack with what was joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        attempt = attempt_name()
        pack = joiner = sink = part = None
        counted = 0

        def close_part() -> None:
            nonlocal part, counted
            if part is None:
                return
            said, at, n, n_out, read, out, crc, _ = part
            if n != said["n"] or (said["crc"] is not None and (read, crc) != (said["n_read"], said["crc"])):
                raise BrokenFile(f"{said['source_id']}: {n} frames, {read} bytes, checksum {crc} read; {said['n']}, {said['n_read']}, {said['crc']} stated")
            rows.append((*(said[c] for c in ("source_id", "stream_name", "day", "pack", "first", "file_id", "small")), at, n, n_out, read, out, crc, None))
            counted += n_out
            part = None

        def close_pack() -> None:
            nonlocal sink, counted
            close_part()
            if pack is None:
                return
            joiner.check()
            length, crc = sink.length_and_crc()
            if (length, crc) != (joiner.bytes_out, joiner.crc):
                raise BrokenFile(f"{sink.path}: length or checksum differs after writing")
            rows.append((None, *pack, None, None, None, 0, None, counted, joiner.bytes_in, length, crc, sink.publish()))
            counted = 0

        for batch in batches:
            for r in batch.to_pylist():
                this = (r["stream_name"], r["day"], r["pack"])
                if this != pack:
                    close_pack()
                    stream = None if this[0] == NO_STREAM else this[0]
                    pack, joiner = this, Joiner("frames")
                    sink = Output(f"{out_dir.rstrip('/')}/{r['folder']}/{folder_name(stream)}", f"pack-{this[2]:05d}", attempt)
                if r["data"] is None:
                    close_part()
                    part = [r, joiner.bytes_out, 0, 0, 0, 0, 0, -1]
                    gone = np.sort(np.frombuffer(r["gone"], np.int64)) if r["gone"] else np.empty(0, np.int64)
                    continue
                if part is None or (part[0]["source_id"], part[0]["chunk"]) != (r["source_id"], r["chunk"]):
                    raise BrokenFile(f"{r['source_id']}: bytes nobody announced")
                size = np.frombuffer(r["sizes"], np.int64)
                seq = r["first_seq"] + np.arange(len(size))
                data, again = r["data"], int(np.searchsorted(seq, part[7], side="right"))
                if again:  # rows stored once more
                    data, size, seq = data[int(size[:again].sum()) :], size[again:], seq[again:]
                if not len(seq):
                    continue
                keep = ~np.isin(seq, gone, assume_unique=True) if len(gone) else np.ones(len(seq), bool)
                ends = np.cumsum(size)
                if keep.all():
                    pieces = [data]
                else:
                    turn = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
                    pieces = [data[int(ends[a] - size[a]) : int(ends[b - 1])] for a, b in zip(turn[::2], turn[1::2])]
                for piece in pieces:
                    sink.write(joiner.add(piece))
                    part[5] += len(piece)
                part[2], part[3], part[4] = part[2] + len(seq), part[3] + int(keep.sum()), part[4] + len(data)
                part[6], part[7] = zlib.crc32(data, part[6]), int(seq[-1])
            if len(rows) >= 2000:
                yield _rows(rows, _MANIFEST_NAMES, _MANIFEST_TYPES)
        close_pack()
        yield _rows(rows, _MANIFEST_NAMES, _MANIFEST_TYPES)

    return run


def fold_frames(frames: DataFrame, files: DataFrame, out_dir: str | None = None, limit: int = SMALL_FILE_BYTES, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Join the files of each stream's UTC day into packs ``<out_dir>/YYYY/MM/DD/<stream>/pack-<n>`` of about
    ``pack_bytes`` that hold every distinct frame once, and yield the manifest.

    A member row (``source_id`` not null) is a file, or a chunk of a large one: file_id, pack, place ``at`` in it, frames
    and bytes in and out, and ``fold``: the file is smaller than ``limit``, shares its stream and day with another and is
    not contained in one other file of more distinct frames (or as many and a smaller file_id). A pack row has the path,
    bytes and CRC-32 of a pack. The frames decide over the catalogue (``files``: path, file_id); a file it does not
    know has a null file_id and ranks last. Frames without source_id, seq, tm_ns or raw belong to no file; rows with
    the same source_id and seq count once; a null stream is one of its own; an empty table gives no rows.

    A frame that several files hold stays with the file of most distinct frames, so a contained file gives no bytes.
    Identities are combined per task and compared in one shuffle, bytes are shuffled once, to their pack. ``out_dir``
    must be new or empty (a folder all executors share); None takes one in the shared folder."""
    spark = frames.sparkSession
    out_dir = out_dir or scratch_path(spark, "packs")
    if not is_empty(out_dir):
        raise FileExistsError(out_dir)
    pieces = file_pieces(frames, files, limit)
    keys = pieces.where(f"kind = {KEYS}").select("keys", "seqs", "weight", "rank", "own").mapInArrow(_identities, _KEY)
    ordered = keys.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.desc("weight"), "rank", "seq")
    gone = cut_lineage(ordered.mapInArrow(_repeats, "rank long, seq long, holder long"))

    totals = pieces.where(f"kind = {SEEN}")
    days = totals.groupBy("stream_name", "day").agg(F.count_if("first").alias("n_files"), F.sum("n_bytes").alias("day_bytes"))
    days = days.select("stream_name", "day", "n_files", F.greatest(F.lit(1), whole_div(F.col("day_bytes") + (pack_bytes - 1), pack_bytes)).cast("int").alias("n_packs"))
    days = broadcast_if_small(cut_lineage(days))
    held = gone.where("holder <> rank").groupBy("rank").agg(F.count("*").alias("n_held"), F.min("holder").alias("one"), F.max("holder").alias("other"))
    whole = totals.where("first").join(held, "rank").where(f"weight < {LARGE} and n_held = weight").select("rank", "one", "other")
    whole = cut_lineage(whole)
    doubtful = whole.where("one <> other").select("rank")
    covered = whole.where("one = other").select("rank")
    if not doubtful.isEmpty():
        covered = covered.unionByName(_contained(pieces, doubtful))
    lists = gone.groupBy("rank", whole_div(F.col("seq"), CHUNK_FRAMES).alias("chunk")).agg(F.collect_list("seq").alias("list"))

    def pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.array(x, np.int64).tobytes() for x in b.column("list").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("chunk"), pa.array(blobs, pa.binary())], ["rank", "chunk", "gone"])

    lists = lists.mapInArrow(pack_lists, "rank long, chunk long, gone binary")
    stated = totals.join(lists, ["rank", "chunk"], "left").join(covered.withColumn("covered", F.lit(True)), "rank", "left").join(days, ["stream_name", "day"])
    small = (F.col("file_bytes") < limit) & (F.col("n_files") >= 2) & F.col("covered").isNull()
    place = [F.pmod(F.xxhash64("source_id", "chunk"), F.col("n_packs")).alias("pack"), day_text(F.col("day")).alias("folder")]
    stated = stated.select("source_id", "stream_name", "day", *place, "chunk", F.lit(-1).cast("long").alias("first_seq"), "first", "file_id", small.alias("small"), "n", "n_read", "crc", "gone", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("binary").alias("data"))
    blobs = _stored(frames).select(*_FILE, "seq", "raw").mapInArrow(_blobs, _DATA).join(days, ["stream_name", "day"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first", "boolean"), ("file_id", "long"), ("small", "boolean"), ("n", "long"), ("n_read", "long"), ("crc", "long"), ("gone", "binary"))]
    blobs = blobs.select("source_id", "stream_name", "day", *place, "chunk", "first_seq", *none, "sizes", "data")
    by = ["stream_name", "day", "pack"]
    rows = stated.unionByName(blobs).repartition(*by).sortWithinPartitions(*by, "source_id", "chunk", "first_seq")
    done = cut_lineage(rows.mapInArrow(_joiner(out_dir), _MANIFEST))
    stream = F.when(F.col("stream_name") != NO_STREAM, F.col("stream_name")).alias("stream_name")
    return done.select("source_id", "file_id", stream, day_text(F.col("day")).alias("file_day"), "pack", (F.col("small") & F.col("first")).alias("fold"), "at", "n_in", "n_out", "bytes_in", "bytes_out", "crc32", "path")


def folded_files(manifest: DataFrame) -> DataFrame:
    """The listed files that were folded."""
    return manifest.where("fold and file_id is not null").select("file_id", "stream_name", "file_day")


def packs(manifest: DataFrame) -> DataFrame:
    """The packs: stream, day, number, frames, bytes, CRC-32, path."""
    return manifest.where("source_id is null").select("stream_name", "file_day", "pack", F.col("n_out").alias("n_frames"), F.col("bytes_out").alias("n_bytes"), "crc32", "path")


def _append(out_dir: str, kind: str, header: bool, by: list[str], folder, name):
    """Kernel over rows sorted by ``by``: joins ``content`` of each group into one file, which is read again and compared
    before it takes its name."""
    out = _schema("n_files long, bytes_in long, bytes_out long, crc32 long, path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = attempt_name()
        ident, joiner, sink, types = None, None, None, []
        done: list[tuple] = []

        def close() -> None:
            if ident is None:
                return
            joiner.check()
            length, crc = sink.length_and_crc()
            if (length, crc) != (joiner.bytes_out, joiner.crc):
                raise BrokenFile(f"{sink.path}: length or checksum differs after writing")
            done.append((*ident, joiner.n_files, joiner.bytes_in, length, crc, sink.publish()))

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            for row in batch.to_pylist():
                this = tuple(row[c] for c in by)
                if this != ident:
                    close()
                    ident, joiner = this, Joiner(kind, header)
                    sink = Output(f"{out_dir.rstrip('/')}/{folder(row)}", name(row), attempt)
                sink.write(joiner.add(row["content"] or b""))
        close()
        if done:
            yield _rows(done, [*by, *out[1]], [*types, *out[2]])

    return run


def write_packs(placed: DataFrame, out_dir: str, *order: str) -> DataFrame:
    """Join ``raw`` by (stream_name, file_day, pack), in the given order, into
    ``<out_dir>/<file_day>/<stream_name>/pack-<pack>``; yields stream, day, pack, frames, bytes, CRC-32, path."""
    by = ["stream_name", "file_day", "pack"]
    rows = placed.withColumn("content", F.col("raw")).repartition(*by).sortWithinPartitions(*by, *order).select(*by, "content")
    kernel = _append(out_dir, "frames", False, by, lambda r: f"{r['file_day']}/{folder_name(r['stream_name'])}", lambda r: f"pack-{r['pack']:05d}")
    return rows.mapInArrow(kernel, "stream_name string, file_day string, pack long, n_frames long, bytes_in long, n_bytes long, crc32 long, path string").drop("bytes_in")


def pack_files(files: DataFrame, group: Column, out_dir: str, kind: str = "lines", header: bool = False, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Join whole files (``path``, ``length``, ``content`` as the binary file source gives them) per ``group`` into packs
    ``<out_dir>/<group>/pack-<n>`` of about ``pack_bytes``; yields the manifest. ``kind`` is ``lines`` or ``zstd``
    (`blobs.Joiner`). Each file goes to exactly one pack, in order of path; an output's length and checksum are
    verified by reading it again. Empty files add nothing, a null group is one of its own; a broken file (`BrokenFile`)
    stops the job rather than lose records. ``out_dir`` must be new or empty.

    Only lengths are summed per group; each content is shuffled once, to its pack."""
    if not is_empty(out_dir):
        raise FileExistsError(out_dir)
    grouped = files.select(group.cast("string").alias("grp"), "path", F.col("length").cast("long"), "content")
    n = F.greatest(F.lit(1), whole_div(F.sum("length") + (pack_bytes - 1), pack_bytes)).cast("int")
    many = broadcast_if_small(grouped.groupBy("grp").agg(n.alias("n_packs")).withColumnRenamed("grp", "g"))
    placed = grouped.join(many, F.col("grp").eqNullSafe(F.col("g"))).withColumn("pack", F.pmod(F.xxhash64("path"), F.col("n_packs")))
    rows = placed.repartition("grp", "pack").sortWithinPartitions("grp", "pack", "path").select("grp", "pack", "content")
    kernel = _append(out_dir, kind, header, ["grp", "pack"], lambda r: folder_name(r["grp"]), lambda r: f"pack-{r['pack']:05d}")
    return rows.mapInArrow(kernel, "grp string, pack long, n_files long, bytes_in long, bytes_out long, crc32 long, path string")
