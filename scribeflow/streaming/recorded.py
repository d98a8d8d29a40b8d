"""Recorded live sessions as a stream source.

A session is a folder of files of JSON lines, one event a line, whose names ascend
with time.  ``spark.dataSource.register(RecordedSession)``, then
``spark.readStream.format("recorded_session").load(folder)`` gives (file, line, json).
An offset is the name of the last file taken.  Files are only ever added behind it,
so the files between two offsets are the same whenever a batch runs again, and a
stream that starts anew from its checkpoint reads on where it ended.  A file is a
partition; files must be complete when they appear (write elsewhere, then move).
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.storage import listed, opened

LINES = 4096


@dataclass
class EventFile(InputPartition):
    uri: str


class SessionReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _files(self) -> list[tuple[str, str]]:
        """(name, URI) of the files, by name."""
        return sorted((posixpath.basename(uri), uri) for uri, _ in listed(self.folder))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in self._files()), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [EventFile(uri) for name, uri in self._files() if start["after"] < name <= end["after"]]

    def read(self, partition: EventFile) -> Iterator[pa.RecordBatch]:
        fs, path = opened(partition.uri)
        name = posixpath.basename(path)

        def batch(first: int, lines: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line", "json"])

        with fs.open_input_file(path) as src:
            first, held = 0, []
            for line in io.TextIOWrapper(src, "utf-8", newline="\n"):
                held.append(line.rstrip("\n"))
                if len(held) == LINES:
                    yield batch(first, held)
                    first, held = first + LINES, []
            if held:
                yield batch(first, held)

    def commit(self, end: dict) -> None:
        """Recorded files stay: another stream may read them."""


class RecordedSession(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_session"

    def schema(self) -> str:
        return "file string, line long, json string"

    def streamReader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"])
