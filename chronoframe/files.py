"""Files on any storage that Arrow's file systems reach: a local or mounted path, or a URI (``s3://``, ``hdfs://``, ...)."""

from __future__ import annotations

import hashlib
import os
import re
import urllib.parse
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it. As for Spark, a percent sign stands for itself."""
    if m := re.match(r"^file:(?://)?(?=/[^/])", path):  # file:/ as the JVM writes it
        return pafs.LocalFileSystem(), path[m.end() :]
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", path):
        inside, mark, query = path.partition("?")
        return pafs.FileSystem.from_uri(inside.replace("%", "%25") + mark + query)
    return pafs.LocalFileSystem(), path


def each_file(path: str, recursive: bool = True) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files at a path, in no order: itself, or those below it. Hidden files and folders, temporary
    files and indexes are none. A local folder is walked entry by entry, without holding its files."""
    store, at = resolve(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        yield path, info.size
        return
    root = at.rstrip("/")
    if isinstance(store, pafs.LocalFileSystem):
        folders = [root or "/"]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.name[:1] in (".", "_"):
                        continue
                    if e.is_dir():
                        folders += [e.path] * recursive
                    elif e.is_file() and not e.name.endswith((".idx", ".part")):
                        yield prefix + e.path, e.stat().st_size
        return
    hidden = lambda p: any(x[:1] in (".", "_") for x in p[len(root) + 1 :].split("/"))
    for f in store.get_file_info(pafs.FileSelector(at, recursive=recursive)):
        if f.type == pafs.FileType.File and not hidden(f.path) and not f.path.endswith((".idx", ".part")):
            yield prefix + f.path, f.size


def file_sizes(path: str, recursive: bool = True) -> list[tuple[str, int]]:
    """The files of `each_file`, sorted."""
    return sorted(each_file(path, recursive))


def exists(path: str) -> bool:
    store, at = resolve(path)
    return store.get_file_info(at).type != pafs.FileType.NotFound


def is_file(path: str) -> bool:
    store, at = resolve(path)
    return store.get_file_info(at).type == pafs.FileType.File


def is_empty(path: str) -> bool:
    """Whether nothing, or an empty folder, lies at a path."""
    store, at = resolve(path)
    kind = store.get_file_info(at).type
    return kind == pafs.FileType.NotFound or (kind == pafs.FileType.Directory and not store.get_file_info(pafs.FileSelector(at)))


def remove_folder(path: str) -> None:
    store, at = resolve(path)
    if store.get_file_info(at).type == pafs.FileType.Directory:
        store.delete_dir(at)


def folder_name(name: str | None) -> str:
    """A folder name of its own for every text and for null."""
    if name is None:
        return "%"
    quoted = urllib.parse.quote(name, safe="")
    quoted = "%2E" + quoted[1:] if quoted[:1] == "." else "%5F" + quoted[1:] if quoted[:1] == "_" else quoted
    if not quoted:
        return "%%"
    return quoted if len(quoted) <= 200 else f"{quoted[:120]}%%{hashlib.sha256(name.encode()).hexdigest()}"


class Output:
    """A file that appears under its name only once it is whole. Every attempt writes a temporary file of its own, so
    attempts that run side by side do not meet, and a repeated one replaces the file."""

    def __init__(self, folder: str, name: str, attempt: str) -> None:
        self.store, at = resolve(folder)
        self.store.create_dir(at, recursive=True)
        self.path = f"{folder.rstrip('/')}/{name}"
        self._final, self._part = f"{at.rstrip('/')}/{name}", f"{at.rstrip('/')}/.{name}-{attempt}.part"
        self._sink = self.store.open_output_stream(self._part)

    def write(self, data) -> None:
        self._sink.write(data)

    def close(self) -> None:
        if not self._sink.closed:
            self._sink.close()

    def length_and_crc(self) -> tuple[int, int]:
        """Of what is stored, by reading it again."""
        self.close()
        n, crc = 0, 0
        with self.store.open_input_stream(self._part) as f:
            while block := f.read(1 << 20):
                n, crc = n + len(block), zlib.crc32(block, crc)
        return n, crc

    def publish(self) -> str:
        self.close()
        self.store.move(self._part, self._final)
        return self.path

    def discard(self) -> None:
        self.close()
        self.store.delete_file(self._part)


def attempt_name() -> str:
    """A name for the running task attempt."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.stageId()}-{context.taskAttemptId()}" if context else "driver"
