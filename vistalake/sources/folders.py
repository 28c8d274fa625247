"""A data source that lists folders in tasks and reads the two ends of each file, never more.

`spark.dataSource.register(FolderSource)`, then `spark.read.format("folders").load(root)`; or `list_folders`.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, modified_us long, modified_at double, created_at double, head binary, tail binary"
#: Bytes read from either end; folders that planning opens at most before tasks take over; files of a batch of rows.
ENDS, FOLDERS, BATCH = 8192, 1000, 1000


def file_extension(name: str) -> str:
    """Lower-cased extension with its dot; dots that a name begins with start none."""
    return os.path.splitext(name)[1].lower()


@dataclass
class Entry:
    path: str
    name: str
    is_folder: bool


class LocalFolders:
    """Paths that tasks open themselves: local disks and mounts that all machines share. Links to folders aren't followed, links to files are."""

    def entries(self, folder: str) -> list[Entry]:
        with os.scandir(folder) as found:
            rows = [(e, e.is_dir(follow_symlinks=False)) for e in found]
            return sorted((Entry(e.path, e.name, is_folder) for e, is_folder in rows if is_folder or e.is_file()), key=lambda e: e.path)

    def facts(self, path: str) -> tuple[int, int, float]:
        found = os.stat(path)
        if not stat.S_ISREG(found.st_mode):
            raise OSError(f"no file: {path}")
        return found.st_size, found.st_mtime_ns // 1000, found.st_ctime

    def ends(self, path: str, size: int, n: int) -> tuple[bytes, bytes]:
        with open(path, "rb") as f:
            head = f.read(n)
            f.seek(max(0, size - n))
            return head, f.read(n)


class StoreFolders:
    """Other stores that pyarrow reaches by a URI; they tell no creation time."""

    def __init__(self, uri: str):
        from pyarrow.fs import FileSystem

        self.fs, root = FileSystem.from_uri(uri)
        self.prefix = uri.rstrip("/")[: -len(root.rstrip("/"))] if root.rstrip("/") else uri

    def _inside(self, path: str) -> str:
        return path[len(self.prefix) :]

    def entries(self, folder: str) -> list[Entry]:
        from pyarrow.fs import FileSelector, FileType

        found = self.fs.get_file_info(FileSelector(self._inside(folder)))
        return sorted((Entry(self.prefix + i.path, i.base_name, i.type == FileType.Directory) for i in found), key=lambda e: e.path)

    def facts(self, path: str) -> tuple[int, int, None]:
        info = self.fs.get_file_info(self._inside(path))
        if not info.is_file:
            raise OSError(f"no file: {path}")
        return info.size, (info.mtime_ns or 0) // 1000, None

    def ends(self, path: str, size: int, n: int) -> tuple[bytes, bytes]:
        with self.fs.open_input_file(self._inside(path)) as f:
            head = f.read(min(n, size))
            f.seek(max(0, size - n))
            return head, f.read(min(n, size))


def plain_path(path: str) -> str:
    """A file: URI as a plain path; others as they are."""
    uri = urlparse(path)
    return unquote(uri.path) if uri.scheme == "file" else path


def folders_of(root: str) -> LocalFolders | StoreFolders:
    return StoreFolders(root) if urlparse(root).scheme else LocalFolders()


@dataclass
class Folder(InputPartition):
    """A folder to list: with all that is below it, or its files only."""
    path: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the source needs a path")
        self.root = plain_path(options["path"])
        self.root = self.root.rstrip("/") or "/"
        self.exclude = [plain_path(x).rstrip("/") for x in options.get("exclude", "").split("\n") if x.strip()]
        self.extensions = {x.strip().lower() for x in options.get("extensions", "").split(",") if x.strip()}
        self.ends, self.most = int(options.get("ends", ENDS)), int(options.get("folders", FOLDERS))

    def _wanted(self, folder: Entry) -> bool:
        return not folder.name.startswith(".") and not any(folder.path == x or folder.path.startswith(x + "/") for x in self.exclude)

    def partitions(self) -> list[Folder]:
        """Folders are opened level by level until `folders` of them are known; what lies below is left to the tasks. A folder that was opened is read again for its files only."""
        where, level, done = folders_of(self.root), [self.root], []
        while level and len(done) + len(level) < self.most:
            below = []
            for at, folder in enumerate(level):
                try:
                    below += [e.path for e in where.entries(folder) if e.is_folder and self._wanted(e)]
                except OSError:
                    if folder == self.root:
                        raise
                if len(done) + at + len(below) >= self.most:  # the rest of this level is left as it is
                    return [Folder(p, False) for p in done + level[: at + 1]] + [Folder(p, True) for p in level[at + 1 :] + below]
            done += level
            level = below
        return [Folder(p, False) for p in done] + [Folder(p, True) for p in level]

    def _files(self, where: LocalFolders | StoreFolders, folder: str, deep: bool) -> Iterator[str]:
        """Depth first; a folder that can't be opened any more has no files."""
        waiting = [folder]
        while waiting:
            try:
                found = where.entries(waiting.pop())
            except OSError:
                continue
            for e in found:
                if e.is_folder:
                    if deep and self._wanted(e):
                        waiting.append(e.path)
                elif not self.extensions or file_extension(e.name) in self.extensions:
                    yield e.path

    def _row(self, where: LocalFolders | StoreFolders, path: str) -> tuple:
        try:
            size, modified, created = where.facts(path)
        except OSError:
            return path, None, None, None, None, None, None
        head = tail = None
        if self.ends:
            try:
                head, tail = where.ends(path, size, self.ends)
            except OSError:
                pass
        return path, size, modified, modified / 1e6, created, head, tail

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        where = folders_of(self.root)
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified_us", pa.int64()), ("modified_at", pa.float64()), ("created_at", pa.float64()), ("head", pa.binary()), ("tail", pa.binary())])
        rows: list[tuple] = []
        for path in self._files(where, partition.path, partition.deep):
            rows.append(self._row(where, path))
            if len(rows) == BATCH:  # at most BATCH * 2 * ENDS bytes
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class FolderSource(DataSource):
    """Options: path; exclude (folders, one to a line); extensions (comma-separated, with dots; all files without); ends (bytes read at either end of a file, 0 for none); folders."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def list_folders(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = (), ends: int = ENDS, folders: int = FOLDERS) -> DataFrame:
    """Manifest (path, length, modified_us, modified_at, created_at, head, tail) of the files under `root`, for inventory and with_fingerprint.

    Names that begin with `.` or `_` are files like any other; folders that begin with `.`, excluded folders with all
    below them, and links to folders are left out; the root is read whatever its name. A file that can't be read has null ends, and
    one that has gone has its path only: with_fingerprint takes the path's md5 for both. Of each file `ends` bytes are
    read at either end, whatever its size. Folders are listed in tasks: planning opens `folders` of them at most.
    An excluded folder leaves out itself, not folders whose names begin alike.
    """
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folders").option("ends", ends).option("folders", folders).option("exclude", "\n".join(exclude)).option("extensions", ",".join(extensions))
    return reader.load(root)
