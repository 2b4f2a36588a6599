"""A sink of one file for each row: files are written aside by the tasks and take their names when the job commits."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_files"


@dataclass
class _Written(WriterCommitMessage):
    """What a task has put aside: (place aside, name)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType) -> None:
        missing = {"name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows of a file need a name and a content; missing: {', '.join(sorted(missing))}")
        self.folder, self.job = folder, uuid.uuid4().hex

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        """The file system of the folder, whose path may be a URI, and its path there."""
        return pyarrow.fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.folder)

    def _aside(self, root: str) -> str:
        return posixpath.join(root, f"_writing-{self.job}")

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, root = self._system()
        aside, done = posixpath.join(self._aside(root), uuid.uuid4().hex), []
        system.create_dir(aside)
        for n, row in enumerate(iterator):
            name, content = row["name"], row["content"]
            if not name or name in (".", "..") or "/" in name or "\\" in name:
                raise ValueError(f"not a file name: {name!r}")
            place = f"{aside}/{n}"
            with system.open_output_stream(place) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            done.append((place, name))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = self._system()
        files = [f for m in messages if m for f in m.files]
        seen = set()
        for _, name in files:
            if name in seen:
                self.abort(messages)
                raise ValueError(f"two rows for the file {name!r}")
            seen.add(name)
        for place, name in files:
            system.move(place, posixpath.join(root, name))
        if system.get_file_info(self._aside(root)).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(self._aside(root))

    def abort(self, messages: list[_Written | None]) -> None:
        system, root = self._system()
        if system.get_file_info(self._aside(root)).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(self._aside(root))


class NamedFiles(DataSource):
    """Rows (name, content as text or bytes) as files of a folder. A file is there whole or not at all: attempts of tasks that fail or run twice
    leave nothing, and a job that fails leaves no file. A file of the same name is replaced. Other columns are not written.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes df.write.format(FORMAT).mode("append").save(folder) known to a session."""
    spark.dataSource.register(NamedFiles)
