"""Files written by tasks and committed by the driver: a Python data source for named files of any content.

``rows.write.format("named_files").mode("append").save(folder)`` writes each row's ``content`` (text
or bytes) to the file ``name`` below the folder. Every task attempt writes into a folder of
its own below ``_writing-*``; only files of attempts that Spark accepts are moved to their names
when all tasks have ended, so lost, repeated and failed attempts leave nothing behind. ``overwrite`` replaces
files of the same names, ``append`` refuses them before it moves any.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Files that are moved at a time.
MOVERS = 8


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{posixpath.abspath(uri)}")


def checked_name(name: str | None) -> str:
    """A relative file name that stays below its folder."""
    if not name or name.startswith("/") or ".." in name.split("/") or name.split("/")[0].startswith("_writing-"):
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, and the names of the files 0, 1, ... there."""

    attempt: str
    names: list[str]

    @property
    def files(self) -> list[tuple[str, str]]:
        """Temporary path and name of each file."""
        return [(f"{self.attempt}/{k}", name) for k, name in enumerate(self.names)]


class FileSink(DataSourceArrowWriter):
    """Writers derive from this and say in ``files`` which content goes to which name."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.folder)
        attempt, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for k, (name, parts) in enumerate(self.files(iterator)):
            checked_name(name)
            if not k:
                fs.create_dir(attempt, recursive=True)
            with fs.open_output_stream(f"{attempt}/{k}") as out:
                for part in parts:
                    out.write(part)
            names.append(name)
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.folder)
        files = [(path, f"{root}/{name}") for m in messages if m for path, name in m.files]
        names = [name for _, name in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("several rows have the same file name")
            if not self.overwrite:
                for k in range(0, len(names), 1000):
                    there = [i.path for i in fs.get_file_info(names[k : k + 1000]) if i.type != pafs.FileType.NotFound]
                    if there:
                        raise FileExistsError(there[0])
            for folder in {posixpath.dirname(n) for n in names}:
                fs.create_dir(folder, recursive=True)
            with ThreadPoolExecutor(MOVERS) as pool:
                deque(pool.map(lambda f: fs.move(*f), files), 0)
        finally:
            self._forget(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*file_system(self.folder))

    def _forget(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    """Write-only: ``name`` and ``content`` of files."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileSink:
        if [f.name for f in schema.fields] != ["name", "content"] or schema["content"].dataType.typeName() not in ("string", "binary"):
            raise ValueError("named files have the columns name and content, a text or bytes")
        return _NamedFiles(self.options["path"], overwrite)


class _NamedFiles(FileSink):
    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                yield name, iter([content.encode() if isinstance(content, str) else content or b""])
