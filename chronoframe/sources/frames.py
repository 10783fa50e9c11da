"""The frame file format as a Spark data source: batch scan, sink, and following growing files.

    register(spark)
    spark.read.format("chronoframe").option("columns", "tm_ns,pti,v0").load("/archive")
    frames.write.format("chronoframe").mode("append").save("/out")
    spark.readStream.format("chronoframe").option("path", "/archive").load()

A frame file has no sync marker, so it can only be entered where a header walk says. Small files are packed together
into partitions; files beyond ``splitBytes`` are cut where a Spark job that walks their headers has found frames to start
(`split_points`), and the pieces are packed together too; the driver reads no file. Every task reads its bytes in blocks and decodes only the columns asked for.
"""

from __future__ import annotations

import json
import pickle
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from chronoframe import vectors
from chronoframe.files import Output, attempt_name, each_file, file_sizes, folder_name, is_file, resolve
from chronoframe.schema import DAY_NS, DEFAULT_MAX_FRAME_BYTES, FRAME_SCHEMA, TooShort

FORMAT = "chronoframe"
PACK_BYTES = 64 << 20
OPEN_BYTES = 16 << 10  # what opening a file counts when files are packed
SPLIT_BYTES = 256 << 20
LEDGER_FILES = 1000
BATCH_ROWS, BLOCK_BYTES = 20_000, 4 << 20
_DAY = re.compile(r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/")


def list_files(path: str, recursive: bool = True) -> list[str]:
    """The frame files at a path: itself, or those in it. Hidden files, temporary ones and indexes are none."""
    return [p for p, _ in file_sizes(path, recursive)]


def day_of_path(path: str) -> int | None:
    """Start of the UTC day a file lies in by the layout YYYY/MM/DD/..., in nanoseconds."""
    import datetime

    m = _DAY.search(path)
    try:
        return (datetime.date(*map(int, m.groups())) - datetime.date(1970, 1, 1)).days * DAY_NS if m else None
    except ValueError:
        return None


class Piece(InputPartition):
    """Parts of files: (path, first byte, end byte, first seq). They are kept compressed, as paths repeat each other and the
    driver holds the parts of all tasks."""

    def __init__(self, parts: list[tuple[str, int, int | None, int]]) -> None:
        self.packed = zlib.compress(pickle.dumps(parts), 1)

    @property
    def parts(self) -> list[tuple[str, int, int | None, int]]:
        return pickle.loads(zlib.decompress(self.packed))


def _pieces(parts: Iterable[tuple[str, int, int | None, int, int]], least: int) -> Iterator[Piece]:
    """Partitions of at least ``least`` bytes each, openings counted, but for the last, from parts with their bytes."""
    held, size = [], 0
    for *part, n in parts:
        held.append(tuple(part))
        size += n + OPEN_BYTES
        if size >= least:
            yield Piece(held)
            held, size = [], 0
    if held:
        yield Piece(held)


def _blocks(path: str, start: int, end: int | None, limit: int, fail_fast: bool) -> Iterator[tuple[memoryview, np.ndarray, np.ndarray, int]]:
    """(bytes, starts, sizes, place of the bytes in the file) of the frames in a stretch of a file, read in blocks. A frame
    cut off at the end is dropped, or refused if ``fail_fast``."""
    store, at = resolve(path)
    rest, place, size = b"", start, BLOCK_BYTES
    with store.open_input_file(at) as f:
        f.seek(start)
        while True:
            want = size if end is None else min(size, end - place - len(rest))
            more = f.read(want) if want > 0 else b""
            data = rest + more if rest else more
            starts, sizes, upto = vectors.frame_starts(data, limit)
            if len(starts):
                yield memoryview(data), starts, sizes, place
            rest, place = data[upto:], place + upto
            size = BLOCK_BYTES if len(starts) else max(BLOCK_BYTES, 2 * len(rest))  # a frame longer than a block
            if not more:
                if rest and fail_fast:
                    raise TooShort(f"{path} ends inside the frame at {place}")
                return


def _batches(parts: list[tuple[str, int, int | None, int]], schema: StructType, limit: int, fail_fast: bool) -> Iterator[pa.RecordBatch]:
    names = schema.fieldNames()
    for path, start, end, seq in parts:
        for data, starts, sizes, place in _blocks(path, start, end, limit, fail_fast):
            for i in range(0, len(starts), BATCH_ROWS):
                s, k = starts[i : i + BATCH_ROWS], sizes[i : i + BATCH_ROWS]
                cols = vectors.decode(data, s, k, names)
                if "source_id" in names:
                    cols["source_id"] = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(s), np.int32)), pa.array([path])).cast(pa.string())
                if "seq" in names:
                    cols["seq"] = pa.array(seq + np.arange(len(s)), pa.int64())
                if "byte_offset" in names:
                    cols["byte_offset"] = pa.array(place + s, pa.int64())
                seq += len(s)
                yield pa.RecordBatch.from_arrays([cols[n].cast(vectors.TYPES[n]) for n in names], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the batches of small files put together."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if held and (rows + batch.num_rows > BATCH_ROWS or size + batch.nbytes > BLOCK_BYTES):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def split_points(spark: SparkSession, files: Iterable[tuple[str, int]], every: int = SPLIT_BYTES) -> dict[str, list[tuple[int, int]]]:
    """(byte, seq) of frames about ``every`` bytes apart in each of the files longer than that, by a job that walks headers,
    in tasks of several files where they are small. What comes to the driver is a pair of numbers per ``every`` bytes."""
    large = [(p, size) for p, size in files if size > every]
    if not large:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, places, seqs = batch.column("path").to_pylist(), [], []
            for path in paths:
                at, first, seq, due = [], [], 0, every
                for _, starts, _, place in _blocks(path, 0, None, 1 << 62, False):
                    i = int(np.searchsorted(starts, due - place))
                    while i < len(starts):
                        at.append(place + int(starts[i]))
                        first.append(seq + i)
                        due = at[-1] + every
                        i = int(np.searchsorted(starts, due - place))
                    seq += len(starts)
                places.append(at)
                seqs.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(places, pa.list_(pa.int64())), pa.array(seqs, pa.list_(pa.int64()))], ["path", "at", "seq"])

    tasks = min(len(large), max(4 * spark.sparkContext.defaultParallelism, sum(size for _, size in large) // PACK_BYTES))
    found = spark.createDataFrame([(p,) for p, _ in large], "path string").repartition(tasks).mapInArrow(run, "path string, at array<long>, seq array<long>").toArrow()
    return {p: list(zip(at, seq)) for p, at, seq in zip(*(found.column(c).to_pylist() for c in ("path", "at", "seq"))) if at}


class FrameReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.sources: set[str] | None = None
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files are pruned by source_id, and by tm_ns where ``layout=day`` says that a file's directory is the UTC
        day of its frames. Every filter is still applied to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("source_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
                if wanted is not None:
                    self.sources = wanted if self.sources is None else self.sources & wanted
            elif getattr(f, "attribute", None) == ("tm_ns",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value) if self.low is not None else f.value
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value) if self.high is not None else f.value
            yield f

    def _wanted(self, path: str) -> bool:
        if self.sources is not None and path not in self.sources:
            return False
        day = day_of_path(path) if self.options.get("layout") == "day" else None
        return day is None or not ((self.low is not None and day + DAY_NS <= self.low) or (self.high is not None and day > self.high))

    def partitions(self) -> list[InputPartition]:
        pack, tasks = int(self.options.get("packbytes", PACK_BYTES)), int(self.options.get("tasks", 1))
        splits = json.loads(self.options.get("splits", "{}"))
        whole: list[tuple[str, int, int | None, int, int]] = []
        cut: list[tuple[str, int, int | None, int, int]] = []
        for path, length in file_sizes(self.options["path"], self.options.get("recursive", "true").lower() != "false"):
            if not self._wanted(path):
                continue
            if path in splits:
                points = [(0, 0), *map(tuple, splits[path])]
                ends = [at for at, _ in points[1:]]
                cut += [(path, at, end, seq, (length if end is None else end) - at) for (at, seq), end in zip(points, [*ends, None])]
            else:
                whole.append((path, 0, None, 0, length))
        size = lambda parts: sum(n + OPEN_BYTES for *_, n in parts)
        out = [*_pieces(cut, min(pack, size(cut) // tasks)), *_pieces(whole, pack)]
        return out or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        limit = int(self.options.get("maxframebytes", DEFAULT_MAX_FRAME_BYTES))
        yield from _joined(_batches(partition.parts, self.schema, limit, self.options.get("mode", "DROPTAIL").upper() == "FAILFAST"))


def _listed(path: str, recursive: bool) -> tuple[str, pa.Array, np.ndarray]:
    """The folder of all files at a path, their names below it and their lengths, as columns."""
    root = "" if is_file(path) else path.rstrip("/") + "/"
    names, sizes = [], []
    files = iter(each_file(path, recursive))
    while chunk := list(islice(files, 10_000)):
        names.append(pa.array([p[len(root) :] for p, _ in chunk], pa.large_string()))
        sizes.append(np.array([n for _, n in chunk], np.int64))
    return root, pa.concat_arrays(names or [pa.array([], pa.large_string())]), np.concatenate(sizes or [np.empty(0, np.int64)])


class Places:
    """How far each file was followed: names below a folder, bytes and frames, and bytes and frames of the step before.
    As columns, since there may be millions of files."""

    def __init__(self, root: str = "", names: pa.Array | None = None, numbers: np.ndarray | None = None) -> None:
        self.root = root
        self.names = pa.array([], pa.large_string()) if names is None else names
        self.numbers = np.zeros((len(self.names), 4), np.int64) if numbers is None else numbers  # at, seq, at and seq before

    def under(self, root: str) -> Places:
        """The same places with names below another folder; only those that lie in it."""
        if root == self.root:
            return self
        full = pc.binary_join_element_wise(pa.scalar(self.root, pa.large_string()), self.names, pa.scalar("", pa.large_string()))
        inside = pc.starts_with(full, root)
        return Places(root, pc.utf8_slice_codeunits(full.filter(inside), len(root)), self.numbers[inside.to_numpy(zero_copy_only=False)])

    def of(self, names: pa.Array) -> np.ndarray:
        """Bytes and frames of the names, 0 where they are unknown."""
        if not len(self.names):
            return np.zeros((len(names), 2), np.int64)
        where = pc.index_in(names, value_set=self.names)
        known = where.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known[:, None], self.numbers[where.fill_null(0).to_numpy(), :2], 0)

    def step(self, names: pa.Array, found: np.ndarray) -> Places:
        """The places after a step that brought the names to new ones."""
        where = pc.index_in(names, value_set=self.names) if len(self.names) else pa.nulls(len(names), pa.int32())
        new = where.is_null().to_numpy(zero_copy_only=False)
        numbers = np.concatenate([np.tile(self.numbers[:, :2], 2), np.zeros((int(new.sum()), 4), np.int64)])
        numbers[where.drop_null().to_numpy(), :2] = found[~new]
        numbers[len(self.names) :, :2] = found[new]
        return Places(self.root, pa.concat_arrays([self.names, names.filter(pa.array(new))]), numbers)

    def write(self, path: str) -> None:
        folder, _, name = path.rpartition("/")
        out = Output(folder, name, uuid.uuid4().hex)
        table = pa.table({"name": self.names, **{f"n{k}": self.numbers[:, k] for k in range(4)}}).replace_schema_metadata({"root": self.root})
        pq.write_table(table, out._sink, compression="zstd")
        out.publish()

    @staticmethod
    def read(path: str) -> Places:
        store, at = resolve(path)
        t = pq.read_table(at, filesystem=store)
        return Places(t.schema.metadata[b"root"].decode(), pa.concat_arrays([pa.array([], pa.large_string()), *t["name"].cast(pa.large_string()).chunks]), np.stack([t[f"n{k}"].to_numpy() for k in range(4)], 1))


class FollowReader(DataSourceStreamReader):
    """Frames appended to the files of a path. An offset is the length and the number of frames of every file up to its last
    complete frame, so a half-written frame is read once it is whole. ``startingAt=end`` skips what is there at the start.

    Beyond ``ledgerFiles`` files an offset only names a file with these numbers, {"": path}. Such files are kept in a
    hidden folder beside the data, or in the folder ``ledger``; of a run, those before the last committed are deleted.

    Each trigger takes at most ``maxBytesPerFile`` more of a file, walked in blocks without holding them; the frames
    themselves are read by the tasks. A file that has not grown is not opened."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.known, self.number, self.ident = Places(), 0, uuid.uuid4().hex[:12]
        self.at: str | None = None  # the ledger's file of what is known, and that of the step before
        self.previous: str | None = None
        self.most = int(options.get("maxbytesperfile", 1 << 30))
        self.pack = int(options.get("packbytes", PACK_BYTES))
        self.inline = int(options.get("ledgerfiles", LEDGER_FILES))
        self.ledger = options.get("ledger") or options["path"].rstrip("/") + "/.followed"

    def _extend(self, most: int | None = None) -> dict:
        root, names, sizes = _listed(self.options["path"], self.options.get("recursive", "true").lower() != "false")
        self.known = self.known.under(root)
        at = self.known.of(names)
        grown = np.flatnonzero(sizes > at[:, 0])
        names, sizes, at = names.take(pa.array(grown)), sizes[grown], at[grown]
        for i in range(len(names)):
            upto = int(sizes[i]) if most is None else min(int(sizes[i]), int(at[i, 0]) + most)
            for _, starts, k, place in _blocks(root + names[i].as_py(), int(at[i, 0]), upto, 1 << 62, False):
                at[i] = place + int(starts[-1] + k[-1]), at[i, 1] + len(starts)
        whole = at[:, 0] > 0
        names, at = names.filter(pa.array(whole)), at[whole]
        changed = len(names) > 0 and bool((self.known.of(names) != at).any())
        if changed:
            self.known, self.at, self.previous = self.known.step(names, at), None, self.at
        if self.at is None and len(self.known.names) > self.inline:
            self.number += 1
            self.at = f"{self.ledger.rstrip('/')}/{self.ident}-{self.number:09d}"
            self.known.write(self.at)
        return {"": self.at} if self.at else {self.known.root + p: x for p, x in zip(self.known.names.to_pylist(), self.known.numbers[:, :2].tolist())}

    def _places(self, offset: dict) -> Places:
        if "" in offset:
            return self.known if offset[""] == self.at else Places.read(offset[""])
        numbers = np.array(list(offset.values()), np.int64).reshape(-1, 2)
        return Places("", pa.array(offset, pa.large_string()), np.concatenate([numbers, numbers], 1))

    def initialOffset(self) -> dict:
        return self._extend() if self.options.get("startingat", "begin") == "end" else {}

    def latestOffset(self) -> dict:
        return self._extend(self.most)

    def _grown(self, start: dict, end: dict) -> Iterator[tuple[str, int, int, int, int]]:
        places = self._places(end)
        if not start:
            before = np.zeros((len(places.names), 2), np.int64)
        elif self.previous and start.get("") == self.previous and end.get("") == self.at:
            before = places.numbers[:, 2:]
        else:
            before = self._places(start).under(places.root).of(places.names)
        for i in np.flatnonzero(places.numbers[:, 0] > before[:, 0]).tolist():
            (at, seq), to = before[i].tolist(), int(places.numbers[i, 0])
            yield places.root + places.names[i].as_py(), at, to, seq, to - at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not len(self.known.names):  # after a restart
            self.known, self.at = self._places(end), end.get("")
        return list(_pieces(self._grown(start, end), self.pack))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        limit = int(self.options.get("maxframebytes", DEFAULT_MAX_FRAME_BYTES))
        yield from _joined(_batches(partition.parts, self.schema, limit, False))

    def commit(self, end: dict) -> None:
        """Files of the ledger before the committed one are no longer needed."""
        if "" in end:
            folder, _, last = end[""].rpartition("/")
            store, at = resolve(folder)
            ident = last.partition("-")[0]
            for f in store.get_file_info(pafs.FileSelector(at)):
                if f.base_name.startswith(f"{ident}-") and f.base_name < last:
                    store.delete_file(f.path)


class Written(WriterCommitMessage):
    def __init__(self, output: str, part: str, rows: int) -> None:
        self.final, self.part, self.rows = output, part, rows


class FrameWriter(DataSourceArrowWriter):
    """Writes each partition's ``raw`` bytes in order to one file; files appear when the whole job commits. Overwriting
    removes the old files only after the new ones have their names."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.raw = options.get("rawcolumn", "raw")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}"
        out = Output(self.path, name, attempt_name())
        rows = 0
        for batch in iterator:
            column = batch.column(batch.schema.get_field_index(self.raw))
            rows += len(column)
            out.write(b"".join(x for x in column.to_pylist() if x is not None))
        out.close()
        return Written(out._final, out._part, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = resolve(self.path)
        old = list_files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                if m.rows:
                    store.move(m.part, m.final)
                else:
                    store.delete_file(m.part)
        for path in old:
            store.delete_file(resolve(path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = resolve(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.part).is_file:
                store.delete_file(m.part)


class FrameSource(DataSource):
    """Options: path, columns (only these are decoded into rows), maxFrameBytes, mode (DROPTAIL or FAILFAST), layout=day,
    packBytes, splits (JSON of `split_points`) and tasks (of their pieces, at least), recursive, startingAt, maxBytesPerFile, ledger and ledgerFiles (streams), rawColumn (sink)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        wanted = self.options.get("columns")
        if not wanted:
            return FRAME_SCHEMA
        names = [c.strip() for c in wanted.split(",")]
        return StructType([FRAME_SCHEMA[n] for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(schema, {k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FollowReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FrameWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def read_frames(spark: SparkSession, path: str, columns: list[str] | None = None, max_frame_bytes: int = DEFAULT_MAX_FRAME_BYTES, mode: str = "DROPTAIL", layout: str | None = None, split_bytes: int = SPLIT_BYTES, recursive: bool = True) -> DataFrame:
    """The frames of a file or folder. Files beyond ``split_bytes`` are first walked by a job to find where to cut them."""
    register(spark)
    r = spark.read.format(FORMAT).option("maxFrameBytes", max_frame_bytes).option("mode", mode).option("recursive", str(recursive).lower())
    splits = split_points(spark, each_file(path, recursive), split_bytes)
    if splits:
        r = r.option("splits", json.dumps(splits)).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    if columns:
        r = r.option("columns", ",".join(columns))
    if layout:
        r = r.option("layout", layout)
    return r.load(path)


def write_frames(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write the frames' bytes. Order within a file is that of the rows in their partition."""
    register(df.sparkSession)
    df.select("raw").write.format(FORMAT).mode(mode).save(path)


def write_sources(frames: DataFrame, directory: str, place=None) -> DataFrame:
    """Write the bytes of each source, in order of ``seq``, to a file of its own below ``directory`` (named by the source,
    or by ``place``, a column of a relative path); yields path, frames and bytes. Rows without source or raw are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = attempt_name()
        ident, sink, n, size, done = None, None, 0, 0, []

        def close() -> None:
            if sink is not None:
                done.append((sink.publish(), n, size))

        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("raw").to_pylist()):
                if name != ident:
                    close()
                    ident, n, size = name, 0, 0
                    folder, _, last = f"{directory.rstrip('/')}/{name}".rpartition("/")
                    sink = Output(folder, last, attempt)
                sink.write(raw)
                n, size = n + 1, size + len(raw)
        close()
        cols = list(zip(*done)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["path", "n_frames", "n_bytes"])

    @F.arrow_udf("string")
    def own_name(source: pa.Array) -> pa.Array:
        codes = source.dictionary_encode()
        return pa.array([folder_name(x) for x in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)

    rows = frames.where("source_id is not null and raw is not null").select((place if place is not None else own_name("source_id")).alias("name"), "seq", "raw")
    return rows.repartition("name").sortWithinPartitions("name", "seq").mapInArrow(run, "path string, n_frames long, n_bytes long")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; empty lines are left out, the last needs no newline."""
    return spark.read.text(path).where("value <> ''")


def read_patterns(path: str) -> list[str]:
    """A short list of patterns from a file, one a line, on the driver."""
    with open(path, encoding="utf-8") as f:
        return [line for line in f.read().split("\n") if line]
