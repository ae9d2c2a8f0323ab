"""A sink of named files, written by the workers where they are made.

Rows have ``name`` and ``content``. A file is written beside its place under a name of the attempt's own and then moved onto it, so a reader never sees
half a file, and a task that is tried again, or twice at once, leaves one. When all tasks are through, ``_SUCCESS`` tells the number of files; if the
write fails, what its finished tasks wrote is removed, as far as it was not there before.

The folder is one that all workers reach: a shared path, or a store that pyarrow knows by its URI.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.shared import ship


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A task's files that were not there before, and how many it wrote."""

    new: list[str]
    count: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow import fs

        store, folder = _at(self.path)
        store.create_dir(folder, recursive=True)
        new, count = [], 0
        for row in iterator:
            if row["name"] is None or posixpath.basename(row["name"]) != row["name"]:
                raise ValueError(f"{row['name']!r} is no file name")
            place, own = f"{folder}/{row['name']}", f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(bytes(row["content"] or b""))
            if store.get_file_info(place).type == fs.FileType.NotFound:
                new.append(place)
            store.move(own, place)
            count += 1
        return Written(new, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _at(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(str(sum(m.count for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, _ = _at(self.path)
        for place in (p for m in messages if m for p in m.new):
            if store.get_file_info(place).type != fs.FileType.NotFound:
                store.delete_file(place)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows of files have a name and a content")
        return FilesWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> None:
    """Writes each row's ``content`` as file ``name`` of the folder."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "content").write.format(Files.name()).mode("append").save(path)
