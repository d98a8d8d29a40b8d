"""One file per row as a Spark data source: notes, and whatever else is a file of its own.

``spark.dataSource.register(SingleFiles)``; rows (name, content) are written with
``df.write.format("single_files").mode("append").save(folder)`` and read back the same way.  Tasks
write below ``_staged-<run>`` and report what they wrote; the commit puts the files of the tasks that
count in place and removes the staging folder, so that lost, doubled or killed
tasks leave nothing.  In mode ``append`` a name that is there already is an error, in
``overwrite`` it is replaced; two rows of one name are an error.  These and names
that are no plain file names end the run before any file is put in place.

A folder of many millions of small files is what no store likes: for those, write
a table.  Each file's size is compared with what was written before it is moved (K4).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .storage import listed, opened

SCHEMA = "name string, content binary"
READ_BYTES = 32 << 20
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: (staged path, name, bytes)."""

    files: list[tuple[str, str, int]]


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = opened(self.folder)
        own = f"{root}/{self.staged}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        files = []
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or name in (".", "..") or "/" in name or name[0] == "_":
                raise ValueError(f"not a file name: {name!r}")
            data = content.encode() if isinstance(content, str) else bytes(content or b"")
            held = f"{own}/{len(files)}"
            with fs.open_output_stream(held) as out:
                out.write(data)
            files.append((held, name, len(data)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        try:
            files = [f for m in messages if m is not None for f in m.files]
            names = [name for _, name, _ in files]
            if len(set(names)) < len(names):
                twice = next(n for n in names if names.count(n) > 1)
                raise ValueError(f"two rows are named {twice!r}")
            there = {i.base_name for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))}
            if not self.overwrite and there & set(names):
                raise FileExistsError(f"{min(there & set(names))!r} is there already")

            def put(file: tuple[str, str, int]) -> None:
                held, name, size = file
                if fs.get_file_info(held).size != size:
                    raise OSError(f"{name!r} was not written whole")
                fs.move(held, posixpath.join(root, name))

            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(put, files))
        finally:
            self._sweep(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*opened(self.folder))

    def _sweep(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staged}")


@dataclass
class Files(InputPartition):
    names: list[str]


class FileReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for uri, length in listed(self.folder):
            if held and size + length > READ_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append(uri)
            size += length + 4096
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for uri in partition.names:
            fs, path = opened(uri)
            with fs.open_input_file(path) as src:
                yield pa.RecordBatch.from_arrays([pa.array([posixpath.basename(path)]), pa.array([src.read()], pa.binary())], names=["name", "content"])


class SingleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)
